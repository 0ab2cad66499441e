import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest_llm import prose
from tokenizers import Tokenizer

from seamline.llm import near_dedup


def good(i, n=90):
    words = prose(i, n).split()
    return ". ".join("the " + " of ".join(words[k : k + 4]) for k in range(0, n, 4)) + "."


def test_stages_take_effect(spark, make):
    rows = [(i, good(i * 13), f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, good(i * 13), "s1") for i in range(10)]  # exact copies: the larger id stays
    rows += [(300 + i, good(i * 13 + 260) + " one more word", "s2") for i in range(5)]  # near copies
    rows += [(400 + i, " ".join(w + "%%%" for w in good(i).split()), "s0") for i in range(15)]  # junk
    rows += [(500, None, "s0"), (501, "", None)]
    docs = make(rows)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    step = stages["quality"](spark, docs, "")
    assert step.columns == columns
    ids = {r[0] for r in step.select("doc_id").collect()}
    assert not ids & set(range(400, 502)) and ids >= set(range(120))
    step = stages["exact_dedup"](spark, step, "")
    kept = {r[0] for r in step.select("doc_id").collect()}
    assert step.columns == columns and kept == (ids - set(range(10)))
    before = {r["doc_id"]: r["text"] for r in step.collect()}
    step = stages["near_dedup"](spark, step, "")
    left = {r["doc_id"]: r["text"] for r in step.collect()}
    assert step.columns == columns and set(left) <= kept
    s = {i: near_dedup.shingles(t.encode()) for i, t in before.items()}
    assert not any(near_dedup.similarity(s[a], s[b]) for a in left for b in left if a < b)
    assert all(any(near_dedup.similarity(s[i], s[j]) for j in left) for i in set(before) - set(left))
    step = stages["mixing"](spark, step, "")
    assert step.columns == columns and {r[0] for r in step.select("doc_id").distinct().collect()} <= set(left)
    mixed = [r["text"] for r in step.collect()]
    pieces = stages["packing"](spark, step, "").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in pieces) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in mixed)
    assert all(len(r["ids"]) == 4 * r["length"] for r in pieces)
    assert np.frombuffer(pieces[0]["ids"], "<u4").size


def test_empty_input(spark, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").isEmpty()


def test_odd_rows_through_every_stage(spark, make):
    rows = [(None, good(1), "a"), (None, good(40), None), (5, good(80), "a"), (5, good(120), "b"), (5, good(120), "b"), (6, good(120), None)]
    rows += [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (7, good(200, 6_000), "c"), (8, good(300) + " extra", "c"), (9, good(300), "c")]
    docs = make(rows)
    stages, texts = dict(corpus_pipeline.STAGES), {}
    step = docs
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        step = stages[name](spark, step, "")
        assert step.columns == docs.columns
        texts[name] = sorted((r["doc_id"] or 0, r["text"]) for r in step.collect())
    full = [(i or 0, t) for i, t, _ in rows if t and t.strip()]
    assert texts["quality"] == sorted(full)
    assert texts["exact_dedup"] == sorted({(0, good(1)), (0, good(40)), (5, good(80)), (6, good(120)), (7, good(200, 6_000)), (8, good(300) + " extra"), (9, good(300))})
    assert texts["near_dedup"] == [x for x in texts["exact_dedup"] if x[0] != 9]
    assert set(texts["mixing"]) <= set(texts["near_dedup"]) and texts["mixing"]
    pieces = stages["packing"](spark, step, "").collect()
    assert sorted({r["doc_id"] or 0 for r in pieces}) == sorted({i for i, _ in texts["mixing"]})


def test_extra_columns_may_have_any_name(spark, make):
    from pyspark.sql import functions as F

    docs = make([(i, good(i * 13), f"s{i % 2}") for i in range(30)] + [(40, good(0), "s1")])
    for n in ("_key", "_kept_id", "_kept_key", "_kept_sha", "_id", "_hash", "_from", "_copies", "_nth", "__key", "a.b"):
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, "")
        assert step.columns == docs.columns, name
        for r in step.collect():
            assert r["_key"] == f"_key{r['doc_id']}" and r["_kept_id"] == f"_kept_id{r['doc_id']}" and r["_nth"] == f"_nth{r['doc_id']}" and r["a.b"] == f"a.b{r['doc_id']}", name
    assert 0 < step.count() and not corpus_pipeline.STAGES[-1][1](spark, step, "").isEmpty()


def test_tables_are_freed(spark, make, tmp_path):
    from seamline.llm import common

    def made():
        top = common.shared_dir(spark).removeprefix("file:") + "/" + spark.sparkContext.applicationId
        return {p.name for p in __import__("pathlib").Path(top).glob("*")}

    common.materialise(spark.range(1), "first")
    before = made()
    with common.freed(spark):
        inner = common.materialise(make([(1, good(1), "s")]), "inner")
        kept = common.materialise(inner, "kept", stays=True)
    assert {n.split("-")[0] for n in made() - before} == {"kept"} and kept.count() == 1


def test_run_is_its_stages(spark, small):
    """The pipeline over the smallest table, against its stages applied one after the other and packed anew."""
    pieces = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], t.encode(r["text"], add_special_tokens=False).ids + [2]) for r in docs.collect())
    copies = {}
    for r in pieces:  # copies of a document are alike: its pieces come as often
        copies.setdefault((r["doc_id"], r["piece"]), []).append(r)
    whole = []
    for i, ids in want:
        if i not in {x for x, _ in whole}:
            parts = [copies[i, k] for k in range(sum(1 for d, _ in copies if d == i))]
            joined = np.concatenate([np.frombuffer(p[0]["ids"], "<u4") for p in parts]).tolist()
            assert joined == ids
            whole += [(i, joined)] * len(parts[0])
    assert sorted(whole) == want
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
