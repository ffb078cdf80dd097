"""Encoding of streams. A text's ids depend on nothing else, so the same columns serve a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns
from tessera.operators.assemble import Padding, assemble
from tessera.plans.spec import TokenizerSpec


def encode_stream(docs: DataFrame, spec: TokenizerSpec, text: str = "text", special: bool = True, max_length: int | None = None, pad_to: int | None = None, pad_id: int = 0) -> DataFrame:
    """docs with input_ids and masks. Rows may be filled up to pad_to; the longest row of a stream isn't known."""
    rows = docs.withColumn("ids", columns.encode(text, spec))
    if pad_to is None:
        return assemble(rows, spec.runtime.template, special=special, max_length=max_length)
    return assemble(rows, spec.runtime.template, special=special, max_length=pad_to if max_length is None else max_length, padding=Padding("max_length", pad_id))


def token_rates(docs: DataFrame, spec: TokenizerSpec, time: str, window: str = "1 minute", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Documents and tokens of each window of event time; what is later than `late` is left out."""
    counted = docs.withColumn("n_tokens", columns.count_tokens(text, spec)).withWatermark(time, late)
    return counted.groupBy(F.window(time, window).alias("span")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).select("span.start", "span.end", "n_docs", "n_tokens")
