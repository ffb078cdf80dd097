"""The vocabulary as a table, and lookups by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.decoders import CLEANUPS
from tessera.plans.spec import TokenizerSpec

BROADCAST_TOKENS = 1_000_000


def vocabulary(spark: SparkSession, spec: TokenizerSpec, with_added: bool = True) -> DataFrame:
    """token, id, added, special. An added token stands in front of a model token of the same name."""
    runtime = spec.runtime
    added = runtime.added
    rows = [(t, i, t in added.by_content, added.is_special(t)) for t, i in runtime.vocab(with_added).items()]
    return spark.createDataFrame(rows, "token string, id int, added boolean, special boolean")


def by_id(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    """id, token, special: what each id decodes to."""
    runtime = spec.runtime
    ids = {*runtime.by_id, *runtime.added.decoded}
    return spark.createDataFrame([(i, t := runtime.id_to_token(i), runtime.added.is_special(t)) for i in sorted(ids)], "id int, token string, special boolean")


def _small(table: DataFrame, spec: TokenizerSpec) -> DataFrame:
    """The table to be broadcast if the vocabulary is within bounds, else as it is."""
    return F.broadcast(table) if len(spec.runtime.vocab()) <= BROADCAST_TOKENS else table


def token_to_id(df: DataFrame, column: str, spec: TokenizerSpec) -> DataFrame:
    """df with id; null where the token isn't known."""
    table = vocabulary(df.sparkSession, spec).select(F.col("token").alias("token_"), "id")
    return df.join(_small(table, spec), df[column] == F.col("token_"), "left").drop("token_")


def id_to_token(df: DataFrame, column: str, spec: TokenizerSpec) -> DataFrame:
    """df with token; null where the id isn't known."""
    table = by_id(df.sparkSession, spec).select(F.col("id").alias("id_"), "token")
    return df.join(_small(table, spec), df[column] == F.col("id_"), "left").drop("id_")


def _cleaned(piece: Column) -> Column:
    for old, new in CLEANUPS:
        piece = F.replace(piece, F.lit(old), F.lit(new))
    return piece


def decoded(df: DataFrame, keys: list[str], spec: TokenizerSpec, skip_special_tokens: bool = False, pos: str = "pos", id_col: str = "token_id") -> DataFrame:
    """keys and text, from a table of (keys, pos, id): the decoder as a join and an ordered aggregate."""
    table = by_id(df.sparkSession, spec).select(F.col("id").alias("id_"), "token", "special")
    rows = df.join(_small(table, spec), df[id_col] == F.col("id_"))
    if skip_special_tokens:
        rows = rows.where(~F.col("special"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos_"), "token"))), lambda x: x["token"])  # a document's own
    prefix = spec.runtime.decoder.prefix
    if prefix is None:
        text = F.array_join(tokens, " ")
    else:
        n = len(prefix)

        def piece(token: Column, k: Column) -> Column:
            one = F.when(k == 0, token).when(F.startswith(token, F.lit(prefix)), F.substr(token, F.lit(n + 1))).otherwise(F.concat(F.lit(" "), token))
            return _cleaned(one) if spec.runtime.decoder.cleanup else one

        text = F.array_join(F.transform(tokens, piece), "")
    return rows.groupBy(*keys).agg(text.alias("text"))
