-- Statements of the serving layer.  Values come as named parameters, never as text; a null
-- turns a filter off.  Tables by machine have a slice, so a machine's statements open one.

-- name: fleet_totals
-- layer: gold
-- question: How large is the fleet, and how many machines are flagged?
SELECT max(generated_at_utc) AS generated_at_utc,
       coalesce(sum(machine_count), 0) AS fleet_size,
       coalesce(sum(machines_flagged), 0) AS machines_flagged,
       coalesce(sum(critical_count), 0) AS critical_count,
       coalesce(sum(warning_count), 0) AS warning_count,
       coalesce(max(days_covered), 0) AS days_covered
FROM fleet_summary_by_type;

-- name: fleet_by_type
-- layer: gold
-- question: How do the equipment types compare, the largest first?
SELECT * EXCEPT (generated_at_utc, days_covered)
FROM fleet_summary_by_type
ORDER BY machine_count DESC, equipment_type;

-- name: health_flags
-- layer: gold
-- question: Which machines need attention, the most urgent first?
SELECT * EXCEPT (slice)
FROM fleet_health_flags
WHERE equipment_type <=> coalesce(CAST(:equipment_type AS STRING), equipment_type)
  AND severity <=> coalesce(CAST(:severity AS STRING), severity)
ORDER BY severity = 'critical' DESC, health_score, equipment_id
LIMIT :limit;

-- name: equipment
-- layer: gold
-- question: Which machines are known, with their flag if they have one, the lowest score first?
WITH known AS (
    SELECT equipment_id, max_by(equipment_type, day) AS equipment_type, max(day) AS last_day
    FROM daily_equipment_summary
    GROUP BY equipment_id
)
SELECT known.*, flag.severity, flag.health_score
FROM known LEFT JOIN fleet_health_flags AS flag ON flag.equipment_id = known.equipment_id
WHERE known.equipment_type <=> coalesce(CAST(:equipment_type AS STRING), known.equipment_type)
  AND (flag.equipment_id IS NOT NULL OR NOT :flagged_only)
ORDER BY flag.health_score NULLS LAST, known.equipment_id
LIMIT :limit;

-- name: equipment_identity
-- layer: gold
-- question: What is this machine, and when was it last read?
SELECT max_by(equipment_type, day) AS equipment_type, max(day) AS last_day
FROM daily_equipment_summary
WHERE equipment_id = :equipment_id AND slice = :slice;

-- name: equipment_days
-- layer: gold
-- question: What did this machine do over the newest days of the table?
SELECT * EXCEPT (slice)
FROM daily_equipment_summary
WHERE equipment_id = :equipment_id AND slice = :slice
  AND day > date_sub((SELECT max(day) FROM daily_newest), :days)
ORDER BY day;

-- name: equipment_flag
-- layer: gold
-- question: Is this machine flagged, and why?
SELECT * EXCEPT (slice)
FROM fleet_health_flags
WHERE equipment_id = :equipment_id AND slice = :slice;
