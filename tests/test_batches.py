"""What engine queries hold at once: Arrow batches, Python's objects of a batch, and arrays that are exploded."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns
from tessera.operators.assemble import exploded
from tessera.plans import queries

from .texts import ALL

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def direct(monkeypatch):
    """Arrow functions run here, on arrays."""
    monkeypatch.setattr(columns.F, "arrow_udf", lambda kind: lambda f: f)


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_segments_are_columns(direct):
    """a dict for each segment of a batch took many times its text."""
    texts = pa.array(["[MASK]".join("abcdefgh"[: 1 + i % 8] for i in range(100))] * 2000)
    found, most = peak(lambda: columns.added_token_segments(texts, queries.spec()))
    assert len(found) == 2000 and len(found.flatten()) == 2000 * 199
    assert most < 12 * texts.nbytes


def test_segments_of_slices(direct, monkeypatch):
    spec = queries.spec()
    added = spec.runtime.added
    texts = pa.array([None, "", *ALL, None, "x" * 5000, "a[MASK]b", ""])
    want = [None if t is None else [("token", added.by_id[p].content, p) if isinstance(p, int) else ("text", p, None) for p in added.split(t, added.raw)] for t in texts.to_pylist()]
    for at_once in (1, 60, 1000, 1 << 20):
        monkeypatch.setattr(columns, "_AT_ONCE", at_once, raising=False)
        for part in (texts, texts.slice(3, 50), texts.slice(0, 0), texts.slice(0, 1)):
            found = columns.added_token_segments(part, spec)
            start = part.offset
            assert [v and [tuple(x.values()) for x in v] for v in found.to_pylist()] == want[start : start + len(part)]


def test_batches_of_queries_are_bounded(spark, tmp_path):
    """All texts of a task, up to 10,000 of any length, were one batch."""
    spark.range(0, 40_000, 1, 1).selectExpr("id as doc_id", "repeat('x', 2000) as text").write.parquet(f"{tmp_path}/documents.parquet")

    @F.arrow_udf("bigint")
    def size(values: pa.Array) -> pa.Array:
        return pa.array([values.nbytes] * len(values), pa.int64())

    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        rows = queries.table(spark, str(tmp_path), "documents").select(size("text").alias("size")).groupBy("size").count().collect()
        assert sum(r["count"] for r in rows) == 40_000 and max(r.size for r in rows) < 3_000_000
    finally:
        spark.conf.set(KEY, before) if before is not None else spark.conf.unset(KEY)


@pytest.mark.parametrize("name", ["truncate_left", "truncate_right", "tokenize_pieces", "encode_ids", "encode_ids_special", "encode_part_names", "pre_bert", "pre_sequence", "text_separator_docs", "added_tokens_split"])
def test_exploded_arrays_are_made_once(spark, name):
    """The optimizer's filter on the size of an exploded column had all texts worked twice."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1 and "Filter" not in plan
    assert plan.count("regexp_extract_all(text") <= 1


def test_exploded_nulls_and_empty_arrays(spark):
    rows = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None), (4, [None])], "k int, a array<int>")
    found = exploded(rows, "a", ["k"])
    assert found.schema.simpleString() == "struct<k:int,pos:bigint,token_id:int>"
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 0, 5), (1, 1, 6), (4, 0, None)]
