import pyarrow as pa

from tessera.llm._common import mapped

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_in_bytes(spark):
    """10,000 rows of 2 kB were one batch; a row longer than the bound still comes whole, and a set bound stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes], "longest": [max(map(len, b.column("t").to_pylist()))]})

    def found():
        docs = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('x', if(id = 5000, 5000000, 2000)) as t")
        return mapped(docs, sizes, "n bigint, size bigint, longest bigint").collect()

    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        rows = found()
        assert sum(r.n for r in rows) == 10_000 and max(r.longest for r in rows) == 5_000_000
        assert max(r.size for r in rows) < 8_000_000 and sum(r.size > 3_000_000 for r in rows) == 1
        spark.conf.set(KEY, "512k")
        assert sum(r.size > 1_000_000 for r in found()) == 1 and spark.conf.get(KEY) == "512k"
    finally:
        spark.conf.set(KEY, before) if before is not None else spark.conf.unset(KEY)
