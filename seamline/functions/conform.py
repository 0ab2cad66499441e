"""Column expressions that conform raw telemetry; native functions only.

They expect ``spark.sql.session.timeZone`` to be UTC, as :mod:`seamline.session` sets it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EQUIPMENT_TYPES, FLAG_ORDER, TYPE_SYNONYMS, UNDER_LOAD_OIL_PSI, VALID_RANGES

#: Instants that a nanosecond clock of 64 bits can hold; others count as unparseable.
_EARLIEST, _LATEST = "1677-09-21 00:12:44", "2262-04-11 23:47:16"
_EPOCH = r"^-?\d{9,}$"
#: An offset at the end; two digits after a dash are one only if a time stands before.
_OFFSET = r"(?:Z|\+\d{2}(?::?\d{2})?|[T ]\d{1,2}(?::\d{1,2})*(?:\.\d+)?\s*-\d{2}(?::?\d{2})?)$"
#: What may reach the cast: it would also read times of today, zone names and words like 'now'.
_GRAMMAR = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d+)?)?)?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _iso(raw: Column) -> Column:
    """Basic and slash forms rewritten to dashes."""
    text = F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    text = F.regexp_replace(text, r"(?<=T)(\d{2})(\d{2})(\d{2})(?=$|[.Z+-])", "$1:$2:$3")
    return F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=$|[T ])", "$1-$2-$3")


def event_time(raw: Column) -> Column:
    """A struct of ``at`` (timestamp or null) and ``assumed_utc`` (a naive form that parsed).

    Epoch seconds or milliseconds (12 digits and more), ISO 8601 with an offset, and naive
    ISO 8601, taken as UTC.  Anything else is null.
    """
    text = strip(raw)
    is_epoch = text.rlike(_EPOCH)
    number = F.when(is_epoch, text.try_cast("bigint"))
    in_ms = F.length(F.regexp_replace(text, "^-", "")) >= 12
    ms = F.when(in_ms, F.when(F.abs(number.cast("double")) < 9.3e15, number)).otherwise(F.when(F.abs(number.cast("double")) < 9.3e12, number * 1000))
    spelled = _iso(text)
    parsed = F.when(is_epoch, F.timestamp_millis(ms)).when(spelled.rlike(_GRAMMAR), spelled.try_cast("timestamp"))
    at = F.when(parsed.between(F.lit(_EARLIEST).cast("timestamp"), F.lit(_LATEST).cast("timestamp")), parsed)
    naive = ~is_epoch & ~spelled.rlike(_OFFSET)
    return F.struct(at.alias("at"), F.coalesce(at.isNotNull() & naive, F.lit(False)).alias("assumed_utc"))


def slug(c: Column) -> Column:
    """Lower case with runs of other characters as single underscores; null: empty."""
    lowered = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def equipment_type(c: Column) -> Column:
    """The canonical type a spelling means, or null.

    Known slugs, then plurals of known slugs, then slugs that contain exactly one
    canonical name.
    """
    known = {t: t for t in EQUIPMENT_TYPES} | TYPE_SYNONYMS
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    s = slug(c)
    stem = F.when(s.endswith("s"), F.substring(s, F.lit(1), F.length(s) - 1))
    inside = F.filter(F.array(*(F.lit(t) for t in EQUIPMENT_TYPES)), lambda t: s.contains(t))
    return F.coalesce(F.try_element_at(table, s), F.try_element_at(table, stem), F.when(F.size(inside) == 1, inside[0]))


def in_range(name: str, c: Column) -> tuple[Column, Column]:
    """(value or null, flag) of a sensor: NaN is missing, infinities and strays are flagged."""
    low, high = VALID_RANGES[name]
    value = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    good = value.between(low, high)
    return F.when(good, value), F.coalesce(~good, F.lit(False))


def null_island(lat: Column, lon: Column) -> Column:
    """Both axes exactly zero: a receiver without a fix."""
    return F.coalesce((lat == 0.0) & (lon == 0.0), F.lit(False))


def under_load(oil: Column) -> Column:
    return F.coalesce(oil > UNDER_LOAD_OIL_PSI, F.lit(False))


def joined_flags(flags: dict[str, Column], order=FLAG_ORDER) -> Column:
    """Names of the flags that fired, comma-joined in order; none: null."""
    return F.nullif(F.concat_ws(",", *(F.when(flags[n], F.lit(n)) for n in order if n in flags)), F.lit(""))


def split_flags(c: Column) -> Column:
    """The names in a comma-joined list, trimmed, without blanks; null: empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


def json_safe(df):
    """Columns as an API returns them: no NaN or infinity, UTC instants as ISO text, dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)
