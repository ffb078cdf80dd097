"""Documents from text and JSON Lines files, as DataFrames with path, doc_index and text.

doc_index is the place of a document in its file, so that the order of the file is kept in the rows. It comes from the
place of the row in its input split: monotonically_increasing_id grows with the split and the row, and a file's splits
are numbered per file. Whole-file documents have 0.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ship


def _paths(paths: Any) -> list[str]:
    if isinstance(paths, (str, os.PathLike)):
        paths = [paths]
    return [os.fspath(p) for p in paths]


@dataclass(frozen=True)
class TextFiles:
    """Text files; each document ends at the separator, or is a whole file where there is none."""

    paths: Any
    separator: str | bytes | None = None

    def __post_init__(self):
        if self.separator is not None and not self.separator:
            raise ValueError("the separator is empty")


@dataclass(frozen=True)
class JsonLines:
    """JSON Lines files; a document is one string field of each object."""

    paths: Any
    field: str = "text"


def has_border(separator: str) -> bool:
    """Some proper prefix is a suffix too, so that where matches lie depends on where one starts to look."""
    return any(separator.endswith(separator[:k]) for k in range(1, len(separator)))


def _checked(read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError(f"No such file: {e.getMessage() if hasattr(e, 'getMessage') else e}") from None
        raise


def lossy_utf8(value: Column | str) -> Column:
    """Bytes to text, each malformed part replaced by U+FFFD."""
    return F.make_valid_utf8(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))


def framed(text: Column | str, separator: str) -> Column:
    """array<string>: the documents of a text; one after a last separator is none if it is empty."""
    parts = F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def read_text(spark: SparkSession, source: TextFiles) -> DataFrame:
    """path, doc_index, text. An empty file has no document; what follows a last separator is none if it is empty."""
    sep = source.separator.decode() if isinstance(source.separator, bytes) else source.separator
    paths = _paths(source.paths)
    path = F.col("_metadata.file_path").alias("path")
    if sep is not None and len(sep) > 1 and len(set(sep)) == 1:
        return _read_runs(spark, paths, sep)
    if sep is None or has_border(sep):
        # whole files; other bordered separators, as "abab", must be looked for from the file's start
        files = _checked(lambda: spark.read.format("binaryFile").load(paths)).select(F.col("path"), lossy_utf8("content").alias("text")).where(F.length("text") > 0)
        if sep is None:
            return files.select("path", F.lit(0).cast("bigint").alias("doc_index"), "text")
        return files.select("path", F.posexplode(framed("text", sep)).alias("doc_index", "text")).withColumn("doc_index", F.col("doc_index").cast("bigint"))
    lines = _checked(lambda: spark.read.option("lineSep", sep).text(paths))
    return _numbered(lines.select(path, lossy_utf8("value").alias("text"), F.col("_metadata.file_block_start").alias("block")))


def _read_runs(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """read_text() for a separator that is one character k times, as "\\n\\n": input splits are read in parallel.

    Lines are read that the character, the mark, ends. A run of m marks holds m div k separators from its start, and the
    m mod k marks left begin what follows. So each line that isn't empty needs the number of marks before it, and the
    separators so far: both are counted in each split, and what stands before a split comes from a row for each split.
    Lines then meet as documents by their number in the file, in the one shuffle of texts."""
    mark, k = sep[0], len(sep)
    ship(spark)
    read = _checked(lambda: spark.read.option("lineSep", mark).text(paths))
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    splits = read.select(*place, F.octet_length("value").alias("bytes"), F.col("_metadata.file_size").alias("size")).groupBy("path", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))

    def scan(batches):
        at, last, seps = None, None, 0
        for batch in batches:
            path, block, row, value = (batch.column(c).to_pylist() for c in ("path", "block", "row", "value"))
            out = []
            for p, b, r, v in zip(path, block, row, value):
                if (p, b) != at:
                    at, last, seps = (p, b), None, 0
                if v:
                    if last is not None:
                        seps += (r - last) // k
                    out.append((p, b, r, last, seps, v))
                    last = r
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "block", "row", "before", "seps", "text"])

    full = read.select(*place, lossy_utf8("value").alias("value")).mapInArrow(scan, "path string, block bigint, row bigint, before bigint, seps bigint, text string")
    ends = full.groupBy("path", "block").agg(F.min("row").alias("first_full"), F.max("row").alias("last_full"), F.max("seps").alias("own_seps"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    # a row for each split: where it starts, the last line before it that isn't empty, and the separators before it
    splits = splits.join(ends, ["path", "block"], "left").withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    splits = splits.withColumn("shift", F.col("start") - F.col("first")).withColumn("full_before", F.max(F.col("last_full") + F.col("shift")).over(earlier))
    marks = F.col("first_full") + F.col("shift") - F.coalesce("full_before", F.lit(0))
    splits = splits.withColumn("first_seps", F.floor(marks / k)).withColumn("seps_before", F.coalesce(F.sum(F.col("first_seps") + F.col("own_seps")).over(earlier), F.lit(0)))
    lines = full.join(splits.select("path", "block", "shift", "full_before", "first_seps", "seps_before"), ["path", "block"])
    before = F.coalesce(F.col("before") + F.col("shift"), F.col("full_before"))
    lines = lines.select("path", (F.col("row") + F.col("shift")).alias("line"), before.alias("before"), (F.col("seps_before") + F.col("first_seps") + F.col("seps")).alias("doc_index"), "text")
    # what follows the last line of a file that isn't empty, as a line of its own
    spare = F.max("size").over(whole) - F.sum("bytes").over(whole) - F.sum("n").over(whole) * len(mark.encode())  # 3 more where the file begins with a byte order mark
    total = F.sum("n").over(whole) - F.when(spare.isin(0, 3), 0).otherwise(1)
    ended = splits.select("path", total.alias("line"), F.max(F.col("last_full") + F.col("shift")).over(whole).alias("before"), F.coalesce(F.sum(F.col("first_seps") + F.col("own_seps")).over(whole), F.lit(0)).alias("seps")).distinct()
    tails = ended.select("path", "line", "before", (F.col("seps") + F.floor((F.col("line") - F.coalesce("before", F.lit(0))) / k)).alias("doc_index"), F.lit("").alias("text"))
    rows = lines.unionByName(tails).withColumn("marks", F.col("line") - F.coalesce("before", F.lit(0)))
    found = F.floor(F.col("marks") / k)
    pieces = rows.select("path", "doc_index", "line", F.concat(F.repeat(F.lit(mark), (F.col("marks") % k).cast("int")), "text").alias("piece")).where("piece <> ''")
    texts = pieces.groupBy("path", "doc_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), "").alias("text"))
    first_empty = F.col("doc_index") - found + F.when(F.col("before").isNull(), 0).otherwise(1)
    empty = rows.where(first_empty < F.col("doc_index")).select("path", F.explode(F.sequence(first_empty, F.col("doc_index") - 1)).alias("doc_index"), F.lit("").alias("text"))
    return texts.unionByName(empty)


def _numbered(rows: DataFrame) -> DataFrame:
    """doc_index from the order of rows in their split and the splits before it; no sort of a whole file's texts: the
    window below sees a row per split, and each row's own place comes from its partition."""
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    blocks = placed.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(starts, ["path", "block"]).select("path", (F.col("row") - F.col("first") + F.col("before")).alias("doc_index"), "text")


def extract_field(line: str | bytes, field: str = "text") -> str:
    """The string value of a top-level key; the first of repeated keys. Anything else is a ValueError."""
    shown = (line if isinstance(line, str) else line.decode("utf-8", "replace"))[:80]
    try:
        found = json.loads(line if isinstance(line, str) else line.decode("utf-8"), object_pairs_hook=_Pairs, parse_constant=_no_constant)
    except ValueError as e:
        raise ValueError(f"invalid JSONL line ({e}): {shown}") from None
    if not isinstance(found, _Pairs):
        raise ValueError(f"invalid JSONL line (no object): {shown}")
    for key, value in found:
        if key == field:
            if isinstance(value, str):
                if _SURROGATE.search(value):
                    raise ValueError(f"invalid JSONL line (half a surrogate pair): {shown}")
                return value
            raise ValueError(f"invalid JSONL line ({field!r} is no string): {shown}")
    raise ValueError(f"no string field {field!r} in JSONL line: {shown}")


_SURROGATE = re.compile("[\ud800-\udfff]")


class _Pairs(list):
    pass


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def extract_field_column(line: Column | str, field: str = "text", strict: bool = True) -> Column:
    """extract_field on a column. Not strict: null where there is no such string, by built-in functions that give
    numbers as strings and take the last of repeated keys."""
    if not strict:
        return F.get_json_object(line, f"$['{field}']")

    @F.arrow_udf("string")
    def extract(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else extract_field(x, field) for x in lines.to_pylist()], pa.string())

    return extract(line)


def read_jsonl(spark: SparkSession, source: JsonLines, strict: bool = True) -> DataFrame:
    """path, doc_index, text: a document for each line that isn't blank."""
    ship(spark)
    raw = _checked(lambda: spark.read.option("lineSep", "\n").text(_paths(source.paths)))
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("block")).where(F.col("text").rlike(r"[^ \t\r\n\f]"))
    return _numbered(lines).withColumn("text", extract_field_column("text", source.field, strict))


def read_documents(spark: SparkSession, source: Any) -> DataFrame:
    """Documents of TextFiles, JsonLines, or of paths as whole files."""
    if isinstance(source, JsonLines):
        return read_jsonl(spark, source)
    return read_text(spark, source if isinstance(source, TextFiles) else TextFiles(source))


def documents(spark: SparkSession, texts: Iterable[str | bytes]) -> DataFrame:
    """doc_index and text of texts in memory."""
    return spark.createDataFrame(list(enumerate(checked_texts(texts))), "doc_index bigint, text string")


def checked_texts(texts: Iterable[str | bytes]) -> list[str]:
    if isinstance(texts, (str, bytes)):
        raise TypeError("expected a list of documents, got a single one")
    return [as_text(t) for t in texts]


def as_text(value: str | bytes) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).decode("utf-8", "replace")
    raise TypeError(f"a document must be str or bytes, not {type(value).__name__}")
