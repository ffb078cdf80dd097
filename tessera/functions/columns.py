"""The tokenizer as DataFrame columns.

Unicode steps and longest match run as Arrow functions, a batch at a time; the runtime is made once per worker process.
Null texts give null. All functions are deterministic, so filters on other columns go below them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.spec import ID, TokenizerSpec
from tessera.sources.files import as_text

from . import unicode as U
from .pretokenizers import compile_pre_tokenizer, patterns


#: Bytes of a batch that are Python's own objects at once.
_AT_ONCE = 1 << 18


def slices(values: pa.Array) -> Iterator[pa.Array]:
    """The values in parts of about _AT_ONCE bytes, a longer value with its part; one part if there are none."""
    long = len(values) > 1 and values.nbytes > _AT_ONCE
    sizes = pc.list_value_length(values) if long and (pa.types.is_list(values.type) or pa.types.is_large_list(values.type)) else pc.binary_length(values) if long else None
    start = 0
    if sizes is not None:
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for stop in np.unique(np.searchsorted(ends, np.arange(_AT_ONCE, int(ends[-1]), _AT_ONCE)) + 1).tolist():
            yield values.slice(start, stop - start)
            start = stop
    if start < len(values) or not start:
        yield values.slice(start)


def joined(parts: list[pa.Array]) -> pa.Array:
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def mapping(kind: str, arrow_kind: pa.DataType, one):
    """An Arrow function of `one` for each value that isn't null."""

    @F.arrow_udf(kind)
    def apply(values: pa.Array) -> pa.Array:
        return joined([pa.array([None if v is None else one(v) for v in part.to_pylist()], arrow_kind) for part in slices(values)])

    return apply


def _mapped(column: Column | str, kind: str, arrow_kind: pa.DataType, one) -> Column:
    return mapping(kind, arrow_kind, one)(column)


def encoding(spec: TokenizerSpec, room: int | None = None, side: str = "right"):
    @F.arrow_udf("array<int>")
    def apply(values: pa.Array) -> pa.Array:
        run = spec.runtime
        one = run.encode_bytes if room is None else lambda text: run.encode_some(text, room, side)
        found = [b"" if v is None else one(as_text(v)) for part in slices(values) for v in part.to_pylist()]
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) // ID for x in found], out=ends[1:])
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=values.is_null() if values.null_count else None)

    return apply


def encode(column: Column | str, spec: TokenizerSpec, room: int | None = None, side: str = "right") -> Column:
    """array<int>: content ids of a text or binary column, without special tokens. room: at most so many, from the start,
    or from the end if the left is cut; what lies far beyond them isn't worked."""
    return encoding(spec, room, side)(column)


def counting(spec: TokenizerSpec):
    return mapping("bigint", pa.int64(), lambda v: len(spec.runtime.encode_bytes(as_text(v))) // ID)


def count_tokens(column: Column | str, spec: TokenizerSpec) -> Column:
    """bigint: number of content ids; only the numbers leave the workers."""
    return counting(spec)(column)


#: Ids up to this one are named by a literal array of tokens in the plan.
_NAMED = 1 << 18


def naming(spec: TokenizerSpec):
    return mapping("array<string>", pa.list_(pa.string()), lambda v: spec.runtime.tokens(spec.runtime.encode(as_text(v))))


def tokenize(column: Column | str, spec: TokenizerSpec) -> Column:
    """array<string>: the tokens of the content ids. Only ids leave the workers; their names are looked up in an array."""
    runtime = spec.runtime
    ids = {*runtime.by_id, *runtime.added.decoded}
    names = [runtime.id_to_token(i) for i in range(max(ids) + 1)] if max(ids) < _NAMED else []
    apart = next((c for c in "\x00\x01\x02\x1f" if not any(c in (n or "") for n in names)), None)
    if not names or apart is None:
        return naming(spec)(column)
    table = F.split(F.lit(apart.join(n or "" for n in names)), apart, -1)  # folded to one literal
    return F.transform(encode(column, spec), lambda i: F.get(table, i))


def normalizing(spec: TokenizerSpec):
    return mapping("string", pa.string(), lambda v: spec.runtime.normalized(as_text(v)))


def normalize(column: Column | str, spec: TokenizerSpec) -> Column:
    return normalizing(spec)(column)


def decoding(spec: TokenizerSpec, skip_special_tokens: bool = False):
    def one(v):
        if any(i < 0 for i in v):
            raise ValueError("invalid token id")
        return spec.runtime.decode(v, skip_special_tokens)

    return mapping("string", pa.string(), one)


def decode(column: Column | str, spec: TokenizerSpec, skip_special_tokens: bool = False) -> Column:
    """string: the text of an array of ids; ids that aren't known are left out."""
    return decoding(spec, skip_special_tokens)(column)


def pre_tokenize(column: Column | str, definition: dict | None, native: bool = False) -> Column:
    """array<string>: the pieces of a `pre_tokenizer` section. native: in built-in functions, within the JVM's Unicode
    version (see unicode.JAVA_CLASSES)."""
    if not native:
        return _mapped(column, "array<string>", pa.list_(pa.string()), lambda v: compiled_pieces(definition)(as_text(v)))
    text = F.col(column) if isinstance(column, str) else column
    steps = [f"(?U){p}" for p in patterns(definition, U.JAVA_CLASSES.__getitem__)]
    if not steps:
        return F.filter(F.array(text), lambda t: t != "")
    pieces = F.regexp_extract_all(text, F.lit(steps[0]), F.lit(0))
    for p in map(F.lit, steps[1:]):
        pieces = F.flatten(F.transform(pieces, _found(p)))
    return pieces


def _found(pattern: Column):
    return lambda text: F.regexp_extract_all(text, pattern, F.lit(0))


def compiled_pieces(definition: dict | None):
    return _compiled(json.dumps(definition))


@lru_cache(16)
def _compiled(text: str):
    return compile_pre_tokenizer(json.loads(text))


def added_token_segments(column: Column | str, spec: TokenizerSpec) -> Column:
    """array<struct<kind, piece, id>>: a text cut at the added tokens that are looked for before normalizing."""
    return segmenting(spec)(column)


def segmenting(spec: TokenizerSpec):
    fields = [pa.field("kind", pa.string()), pa.field("piece", pa.string()), pa.field("id", pa.int32())]

    def segments(texts: pa.Array) -> pa.Array:
        """Columns of all segments, not an object for each."""
        added = spec.runtime.added
        ends, flat = [0], []
        for v in texts.to_pylist():
            if v is not None:
                flat += added.split(as_text(v), added.raw)
            ends.append(len(flat))
        ids = [p if isinstance(p, int) else None for p in flat]
        cols = ["text" if i is None else "token" for i in ids], [p if i is None else added.by_id[i].content for p, i in zip(flat, ids)], ids
        held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, mask=texts.is_null() if texts.null_count else None)

    @F.arrow_udf("array<struct<kind:string,piece:string,id:int>>")
    def apply(values: pa.Array) -> pa.Array:
        return joined([segments(part) for part in slices(values)])

    return apply
