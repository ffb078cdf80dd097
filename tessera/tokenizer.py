"""Tokenizer: local calls on the driver for small inputs, and columns and DataFrames for large ones."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from tessera.functions import columns
from tessera.operators import vocabulary
from tessera.operators.assemble import Padding, assemble, row_ids
from tessera.plans.spec import Runtime, Template, TokenizerSpec, room_for_content
from tessera.ragged import RaggedIds
from tessera.session import ship
from tessera.sources import definitions
from tessera.sources.files import as_text, checked_texts, read_documents


def as_ids(ids) -> list[int]:
    found = [int(i) for i in (ids.tolist() if hasattr(ids, "tolist") else ids)]
    if any(not 0 <= i < 1 << 32 for i in found):
        raise ValueError("invalid token id")
    return found


def round_up(n: int, multiple: int | None) -> int:
    return -(-n // multiple) * multiple if multiple else n


class Tokenizer:
    """A WordPiece tokenizer from a tokenizer.json, a vocab.txt, a folder of them or a live tokenizer object."""

    def __init__(self, source, *, revision: str = "main"):
        self.spec: TokenizerSpec = source.spec if isinstance(source, Tokenizer) else definitions.load(source, revision)
        _ = self.runtime  # a definition that can't be run is refused here

    @classmethod
    def from_json(cls, text, config=None):
        return cls(TokenizerSpec(text.decode() if isinstance(text, bytes) else text, dict(config or {})))

    @classmethod
    def from_vocab(cls, path, **options):
        return cls(TokenizerSpec(definitions.definition_from_vocab(definitions.read_vocab(path), **options)))

    # what it is

    @property
    def runtime(self) -> Runtime:
        return self.spec.runtime

    @property
    def backend(self) -> Runtime:
        """What encodes and decodes single texts."""
        return self.runtime

    @property
    def config(self) -> Mapping:
        return self.spec.config

    @property
    def template(self) -> Template:
        return self.runtime.template

    def to_json(self) -> str:
        return self.spec.text

    def get_vocab(self, with_added_tokens: bool = True) -> dict[str, int]:
        return self.runtime.vocab(with_added_tokens)

    def get_vocab_size(self, with_added_tokens: bool = True) -> int:
        return len(self.get_vocab(with_added_tokens))

    @property
    def vocab_size(self) -> int:
        return self.get_vocab_size()

    @property
    def added_tokens(self) -> list[dict]:
        return [dataclasses.asdict(t) for t in sorted(self.runtime.added.by_id.values(), key=lambda t: t.id)]

    prefix_ids = property(lambda self: list(self.template.prefix))
    suffix_ids = property(lambda self: list(self.template.suffix))
    unk_token = property(lambda self: self.runtime.model.unk)
    continuing_subword_prefix = property(lambda self: self.runtime.model.prefix)
    pad_token_id = property(lambda self: self.token_to_id(self.config.get("pad_token", "[PAD]")))

    def token_to_id(self, token: str) -> int | None:
        return self.runtime.token_to_id(token)

    def id_to_token(self, id: int) -> str | None:
        return self.runtime.id_to_token(id)

    # local calls; parallel is taken for the sake of callers that name it: one process works local texts, Spark large ones

    def encode(self, text, *, add_special_tokens=True) -> np.ndarray:
        return np.array(self.runtime.assembled(self.runtime.encode(as_text(text)), add_special_tokens), np.uint32)

    def encode_batch_list(self, texts: Iterable, *, add_special_tokens=True, max_length=None, truncation_side="right", parallel: bool | None = None) -> list[list[int]]:
        texts = checked_texts(texts)
        room_for_content(self.template if add_special_tokens else Template(), max_length)
        return [self.runtime.assembled(self.runtime.encode(t), add_special_tokens, max_length, truncation_side) for t in texts]

    def encode_batch(self, texts: Iterable, **options) -> RaggedIds:
        return RaggedIds.of(self.encode_batch_list(texts, **options))

    def padded_rows(self, texts: Iterable, *, special=True, cut=None, cut_side="right", pad=None, width=None, multiple=None, side="right", pad_id=0) -> dict[str, list[list[int]]]:
        """Rows and all masks. cut: longest row, or None; pad: None, 'longest' or 'max_length' with its width."""
        t = self.template if special else Template()
        room = room_for_content(t, cut)
        contents = []
        for text in checked_texts(texts):
            ids = self.runtime.encode(text)
            contents.append(ids if room is None or len(ids) <= room else ids[:room] if cut_side == "right" else ids[len(ids) - room :])
        n_special = len(t.prefix) + len(t.suffix)
        if pad == "longest":
            width = max((len(c) for c in contents), default=-n_special) + n_special
        target = round_up(width, multiple) if pad else 0
        out = {k: [] for k in ("input_ids", "token_type_ids", "attention_mask", "special_tokens_mask")}
        for c in contents:
            rest = max(0, target - len(c) - n_special)
            row = {
                "input_ids": ([*t.prefix, *c, *t.suffix], pad_id),
                "token_type_ids": ([*t.prefix_types, *[t.content_type] * len(c), *t.suffix_types], 0),
                "attention_mask": ([1] * (len(c) + n_special), 0),
                "special_tokens_mask": ([1] * len(t.prefix) + [0] * len(c) + [1] * len(t.suffix), 1),
            }
            for name, (values, fill) in row.items():
                out[name].append(values + [fill] * rest if side == "right" else [fill] * rest + values)
        return out

    def encode_batch_padded(self, texts, *, padding="longest", truncation=True, max_length=None, parallel: bool | None = None, **options) -> dict[str, np.ndarray]:
        """Rectangular int64 arrays. options: pad_to_multiple_of, padding_side, truncation_side, add_special_tokens, and
        return_attention_mask, return_token_type_ids, return_special_tokens_mask."""
        known = {"pad_to_multiple_of": None, "padding_side": "right", "truncation_side": "right", "add_special_tokens": True, "return_attention_mask": True, "return_token_type_ids": True, "return_special_tokens_mask": False}
        if unknown := set(options) - set(known):
            raise TypeError(f"unknown options: {sorted(unknown)}")
        o = known | options
        if self.pad_token_id is None:
            raise ValueError("this tokenizer has no pad token")
        if padding not in ("longest", "max_length"):
            raise ValueError(f"unknown padding {padding!r}")
        if padding == "max_length" and max_length is None:
            raise ValueError("padding to max_length needs a max_length")
        rows = self.padded_rows(texts, special=o["add_special_tokens"], cut=max_length if truncation else None, cut_side=o["truncation_side"], pad=padding, width=max_length, multiple=o["pad_to_multiple_of"], side=o["padding_side"], pad_id=self.pad_token_id)
        if len({len(r) for r in rows["input_ids"]}) > 1:
            raise ValueError(f"some documents are longer than max_length={max_length}; truncate them for a rectangular batch")
        wanted = {"input_ids": True, "token_type_ids": o["return_token_type_ids"], "attention_mask": o["return_attention_mask"], "special_tokens_mask": o["return_special_tokens_mask"]}
        n = len(rows["input_ids"])
        return {k: np.array(rows[k], np.int64).reshape(n, -1 if n else 0) for k, on in wanted.items() if on}

    def decode(self, ids, *, skip_special_tokens=False) -> str:
        return self.runtime.decode(as_ids(ids), skip_special_tokens)

    def decode_batch(self, sequences, *, skip_special_tokens=False) -> list[str]:
        return [self.decode(s, skip_special_tokens=skip_special_tokens) for s in sequences]

    def tokenize(self, text) -> list[str]:
        return self.runtime.tokens(self.runtime.encode(as_text(text)))

    # memo: never changes a result

    def clear_cache(self) -> None:
        self.runtime.clear_memo()

    def get_cache_entries(self) -> int:
        return self.spec.memo_entries

    def set_cache_entries(self, entries: int) -> None:
        """Most entries of the memo of each process, this one and the workers'."""
        if entries < 1:
            raise ValueError("a memo needs at least one entry")
        self.spec = dataclasses.replace(self.spec, memo_entries=entries)

    # columns and DataFrames

    def encode_column(self, column: Column | str, *, add_special_tokens=True, max_length=None, truncation_side="right") -> Column:
        """array<int> of ids."""
        room = room_for_content(self.template if add_special_tokens else Template(), max_length)
        return row_ids(columns.encode(column, self.spec, room, truncation_side), self.template, add_special_tokens, max_length, truncation_side)

    def count_column(self, column: Column | str) -> Column:
        return columns.count_tokens(column, self.spec)

    def tokenize_column(self, column: Column | str) -> Column:
        return columns.tokenize(column, self.spec)

    def decode_column(self, column: Column | str, *, skip_special_tokens=False) -> Column:
        return columns.decode(column, self.spec, skip_special_tokens)

    def normalize_column(self, column: Column | str) -> Column:
        return columns.normalize(column, self.spec)

    def encode_frame(self, df: DataFrame, text: str = "text", *, padding: str | None = "longest", max_length=None, truncation=True, batch=(), **options) -> DataFrame:
        """df with input_ids and masks; batch names the columns of a row's batch for the longest row. options as of
        encode_batch_padded."""
        ship(df.sparkSession)
        if padding and self.pad_token_id is None:
            raise ValueError("this tokenizer has no pad token")
        pad = Padding(padding, self.pad_token_id, options.pop("padding_side", "right"), options.pop("pad_to_multiple_of", None), tuple(batch)) if padding else None
        renamed = {"add_special_tokens": "special", "return_attention_mask": "attention_mask", "return_token_type_ids": "token_type_ids", "return_special_tokens_mask": "special_tokens_mask", "truncation_side": "truncation_side"}
        return assemble(df.withColumn("ids_", columns.encode(text, self.spec)), self.template, "ids_", max_length=max_length, truncation=truncation, padding=pad, **{renamed[k]: v for k, v in options.items()})

    def encode_files(self, spark: SparkSession, source, *, add_special_tokens=True, parallel: bool | None = None) -> DataFrame:
        """path, doc_index, ids of the documents in files; order by both for the order of the files."""
        ship(spark)
        return read_documents(spark, source).select("path", "doc_index", self.encode_column("text", add_special_tokens=add_special_tokens).alias("ids"))

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        """SQL functions <prefix>encode, count_tokens, tokenize, normalize_text and decode, and the table function
        <prefix>tokens(text) with pos, token_id and token."""
        from tessera.functions.sql import register

        ship(spark)
        register(spark, self.spec, prefix)

    def vocab_frame(self, spark: SparkSession, with_added_tokens: bool = True) -> DataFrame:
        return vocabulary.vocabulary(spark, self.spec, with_added_tokens)

    def as_hf(self):
        """The call style of the transformers library over this tokenizer."""
        from tessera.compat import CallStyle

        return CallStyle(self)

    def __repr__(self):
        return f"{type(self).__name__}(vocab_size={self.vocab_size})"
