"""Rows from content ids: special tokens, truncation, padding and masks, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.spec import Template, room_for_content
from tessera.session import stored

_SIDES = ("right", "left")


def _side(side: str) -> str:
    if side not in _SIDES:
        raise ValueError(f"side must be one of {_SIDES}, not {side!r}")
    return side


def _ints(values: Iterable[int]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)).cast("array<int>") if values else F.expr("cast(array() as array<int>)")


def truncated(content: Column, room: int | None, side: str = "right") -> Column:
    """At most `room` content ids, from the start, or from the end if the left is cut."""
    if room is None:
        return content
    start = F.lit(1) if _side(side) == "right" else F.greatest(F.size(content) - room + 1, F.lit(1))
    return F.slice(content, start, F.lit(room))


def with_special(content: Column, template: Template) -> Column:
    return F.concat(_ints(template.prefix), content, _ints(template.suffix))


def row_ids(content: Column, template: Template, special: bool = True, max_length: int | None = None, truncation_side: str = "right") -> Column:
    """The ids of a row before padding; max_length holds for the whole row."""
    used = template if special else Template()
    return with_special(truncated(content, room_for_content(used, max_length), truncation_side), used)


def rounded_up(width: Column, multiple: int | None) -> Column:
    return (F.ceil(width / F.lit(multiple)) * multiple).cast("int") if multiple else width


def padded(row: Column, width: Column, fill: int, side: str = "right") -> Column:
    """row with `fill` up to width; a longer row stays as it is."""
    rest = F.array_repeat(F.lit(fill), F.greatest(width - F.size(row), F.lit(0)))
    return F.concat(row, rest) if _side(side) == "right" else F.concat(rest, row)


@dataclass(frozen=True)
class Padding:
    """How rows are filled up: to the longest row of a batch, or to max_length."""

    strategy: str = "longest"
    pad_id: int = 0
    side: str = "right"
    multiple_of: int | None = None
    #: columns that name a row's batch; all rows are one batch if there are none
    batch: tuple[str, ...] = ()


def assemble(
    df: DataFrame,
    template: Template,
    content: str = "ids",
    special: bool = True,
    max_length: int | None = None,
    truncation: bool = True,
    truncation_side: str = "right",
    padding: Padding | None = None,
    attention_mask: bool = True,
    token_type_ids: bool = True,
    special_tokens_mask: bool = False,
) -> DataFrame:
    """df with input_ids and the masks, array<bigint> each, in place of the content ids.

    The longest row of a named batch comes from a window over the batch; of all rows, from an aggregate of lengths that
    is joined as one row. There the ids are stored in the shared folder first, so that texts are encoded once and the
    aggregate reads lengths only. Nothing else moves a row."""
    used = template if special else Template()
    room = room_for_content(used, max_length) if truncation else None
    cut = df.withColumn("content_", truncated(F.col(content), room, truncation_side))
    n_special = len(used.prefix) + len(used.suffix)
    n = F.size("content_") + n_special
    if padding is None:
        sized = cut.withColumn("width_", n)
    elif padding.strategy == "max_length":
        if max_length is None:
            raise ValueError("padding to max_length needs a max_length")
        sized = cut.withColumn("width_", rounded_up(F.lit(max_length), padding.multiple_of))
    elif padding.strategy != "longest":
        raise ValueError(f"unknown padding strategy {padding.strategy!r}")
    elif padding.batch:
        sized = cut.withColumn("width_", rounded_up(F.max(n).over(Window.partitionBy(*padding.batch)), padding.multiple_of))
    else:
        cut = stored(cut.withColumn("n_", n), "rows")
        longest = cut.agg(F.coalesce(F.max("n_"), F.lit(0)).alias("longest_"))
        sized = cut.crossJoin(F.broadcast(longest)).withColumn("width_", rounded_up(F.col("longest_"), padding.multiple_of)).drop("longest_", "n_")  # one row
    side, fill = (padding.side, padding.pad_id) if padding else ("right", 0)
    width, length = F.col("width_"), F.size("content_")

    def column(row: Column, with_fill: int) -> Column:
        return padded(row, width, with_fill, side).cast("array<bigint>")

    def parts(prefix: Iterable[int], middle: int, suffix: Iterable[int]) -> Column:
        return F.concat(_ints(prefix), F.array_repeat(F.lit(middle), length), _ints(suffix))

    made = {"input_ids": column(with_special(F.col("content_"), used), fill)}
    if token_type_ids:
        made["token_type_ids"] = column(parts(used.prefix_types, used.content_type, used.suffix_types), 0)
    if attention_mask:
        made["attention_mask"] = column(F.array_repeat(F.lit(1), n), 0)
    if special_tokens_mask:
        made["special_tokens_mask"] = column(parts([1] * len(used.prefix), 0, [1] * len(used.suffix)), 1)
    return sized.withColumns(made).drop("content_", "width_", content)


def not_rectangular(df: DataFrame, column: str = "input_ids") -> DataFrame:
    """One row: the numbers of rows, and of rows that differ in length from the longest."""
    lengths = df.select(F.size(column).alias("n"))
    return lengths.agg(F.count("*").alias("rows"), F.max("n").alias("width"), F.min("n").alias("least"))


def elements(column: Column | str) -> Column:
    """An array to be exploded; null as an empty one. Of a plain column the optimizer would take `size(column) > 0` for a
    filter, push it below what makes the array, and so have it made twice, Arrow functions and all."""
    return F.coalesce(column, F.array())


def exploded(df: DataFrame, column: str, keys: list[str], value: str = "token_id") -> DataFrame:
    """A row for each element: the keys, pos from 0, and the value."""
    return df.select(*keys, F.posexplode(elements(column)).alias("pos", value)).withColumn("pos", F.col("pos").cast("bigint"))
