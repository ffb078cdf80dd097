"""The tokenizer in SQL: functions over texts and ids, and a table function with a row for each token."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.spec import TokenizerSpec

from . import columns


def tokens(spec: TokenizerSpec):
    """A table function of a text: pos, token_id, token. A null text has no rows."""

    class Tokens:
        def eval(self, text: str):
            if text is not None:
                run = spec.runtime
                for pos, number in enumerate(run.encode(text)):
                    yield pos, number, run.id_to_token(number)

    return F.udtf(Tokens, returnType="pos bigint, token_id int, token string")


def register(spark: SparkSession, spec: TokenizerSpec, prefix: str = "") -> None:
    found = {"encode": columns.encoding(spec), "count_tokens": columns.counting(spec), "tokenize": columns.naming(spec), "normalize_text": columns.normalizing(spec), "decode": columns.decoding(spec)}
    for name, function in found.items():
        spark.udf.register(prefix + name, function)
    spark.udtf.register(f"{prefix}tokens", tokens(spec))
