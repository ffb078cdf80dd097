"""Token ids in binary shards with a minimal perfect hash index for keyed access.

File format. A store is a folder with `shard-NNNNNN.bin` files and `manifest.json` (shards in order with their numbers of
documents and ids). A shard holds, in this order: the raw ids of its documents as little-endian unsigned
integers of 16 bits if the vocabulary allows, else of 32; the index; a footer of six unsigned 64-bit numbers (ids,
documents, levels, bytes of an id, byte offset of the index, magic).
The index is a minimal perfect hash in levels of bit arrays: a key sits at the first level where its bit is set, and its
slot is the number of set bits before it. Each slot keeps a 64-bit fingerprint of its key, the id offset and the number
of ids, so a lookup costs a few hashes and one slot, and a foreign key is refused.

write_store() deals the documents out by ranges of the key, encodes each shard in the task that writes it, and renames
the finished file to its name, so a task that is repeated writes the same file again. Offsets within a shard are local;
the manifest, a row per shard, adds the shards before it and the keys that each begins and ends with, so TokenStore
finds the shard of a key by bisection and asks that shard's index alone. Shards are dealt by size, of about SHARD_BYTES
of text and SHARD_DOCS documents, whatever the session's partitions. Memory is one batch and the index of one shard.

Defined results: a null text is an empty one (only the end id); a null doc_id sorts first and can be looked up as None;
rows that repeat a doc_id are kept in order of their text hash and reached by their occurrence number, also where they
span shards; an empty table gives a store without shards; other columns are ignored; a doc_id column that holds no
integers is refused at once.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from functools import lru_cache
from itertools import chain, takewhile
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

from ._common import integer_id, mapped, pieces

MAGIC = 0x3145524F54534B54
_FOOTER = struct.Struct("<6Q")
_SLOT = np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("n", "<u8"), ("occurrence", "<u4"), ("null", "<u4"), ("doc_id", "<i8")])
#: beyond the Latin blocks, or with an unusual lower case
_NOT_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")
#: lower-cased Latin letters, and such a word with marks behind it: one and two pre-tokens that normalizing leaves alone
_LETTERS = "[a-zß-öø-ÿĀ-įı-ɏ]+"
_WORD = re.compile(f"({_LETTERS})([!-&(-/:-@\\[-`{{-~]*)")
_RANK = 512  # bits between two stored ranks
#: About the text and the documents of a shard.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 250_000


def key_hash(doc_id: int | None, occurrence: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b"\0" if doc_id is None else b"\1" + struct.pack("<qI", doc_id, occurrence)) if occurrence == 0 or doc_id is not None else xxhash.xxh3_64_intdigest(b"\0" + struct.pack("<I", occurrence))


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays over distinct 64-bit keys; gamma bits a key at each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) * 8 for x in levels]
        flat = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        self.starts = np.cumsum([0, *self.sizes])
        self.bits = flat
        ones = np.bitwise_count(flat).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])[:: _RANK // 8]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys must be distinct")
        levels, level = [], 0
        while len(keys):
            m = max(64, int(len(keys) * gamma) + 63 & ~63)
            at = (_mixed(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
            level += 1
        return cls(levels)

    def slot(self, key: int) -> int:
        """Slot of a key, or -1; a key that isn't in the set may get any slot."""
        one = np.array([key], np.uint64)
        for level, m in enumerate(self.sizes):
            at = int(_mixed(one, level)[0] % np.uint64(m)) + int(self.starts[level])
            if self.bits[at >> 3] >> (at & 7) & 1:
                block = at // _RANK
                part = self.bits[block * _RANK // 8 : at >> 3]
                rest = int(self.bits[at >> 3]) & ((1 << (at & 7)) - 1)
                return int(self.ranks[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()
        return -1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of many keys of the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        all_bits = np.unpackbits(self.bits, bitorder="little")
        before = np.concatenate([[0], np.cumsum(all_bits, dtype=np.int64)])
        for level, m in enumerate(self.sizes):
            at = (_mixed(keys[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            hit = all_bits[at] == 1
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<{len(self.levels)}Q", *map(len, self.levels)) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes, n_levels: int) -> tuple[PerfectHash, int]:
        sizes, at, levels = struct.unpack_from(f"<{n_levels}Q", data), 8 * n_levels, []
        for n in sizes:
            levels.append(np.frombuffer(data, np.uint8, n, at))
            at += n
        return cls(levels), at


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; payload goes out as it comes, the index at the end."""

    def __init__(self, uri: str, name: str, width: int = 4):
        self.fs, folder = _filesystem(uri)
        self.width = width
        self.path, self.held = f"{folder}/{name}", f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.held)
        self.ids, self.slots, self.first, self.last, self.seen = 0, [], None, object(), 0

    def add(self, doc_id: int | None, payload: bytes) -> None:
        self.seen = self.seen + 1 if doc_id == self.last else 0
        self.first, self.last = self.first if self.slots else doc_id, doc_id
        key = key_hash(doc_id, self.seen)
        self.out.write(payload)
        self.slots.append((key, self.ids, len(payload) // self.width, self.seen, doc_id is None, doc_id or 0))
        self.ids += len(payload) // self.width

    def close(self) -> tuple[int, int]:
        rows = np.array(self.slots, _SLOT)
        table = PerfectHash.build(rows["fingerprint"].astype(np.uint64))
        placed = np.zeros_like(rows)
        placed[table.slots(rows["fingerprint"])] = rows
        self.out.write(table.to_bytes() + placed.tobytes())
        self.out.write(_FOOTER.pack(self.ids, len(rows), len(table.levels), self.width, self.ids * self.width, MAGIC))
        self.out.close()
        self.fs.move(self.held, self.path)
        return len(rows), self.ids


class ShardReader:
    def __init__(self, uri: str, name: str):
        self.fs, folder = _filesystem(uri)
        self.file = self.fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        self.n_ids, self.n_docs, n_levels, self.width, at, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token shard")
        data = self.file.read_at(size - _FOOTER.size - at, at)
        self.table, used = PerfectHash.from_bytes(data, n_levels)
        self.slots = np.frombuffer(data, _SLOT, self.n_docs, used)

    def find(self, doc_id: int | None, occurrence: int = 0) -> np.void | None:
        key = key_hash(doc_id, occurrence)
        slot = self.table.slot(key)
        return None if slot < 0 or int(self.slots[slot]["fingerprint"]) != key else self.slots[slot]

    def ids(self, row: np.void) -> np.ndarray:
        data = self.file.read_at(int(row["n"]) * self.width, int(row["offset"]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        row = self.find(doc_id, occurrence)
        return None if row is None else self.ids(row)


class ChunkEncoder:
    """Ids of texts by the tokenizers library, a memo of the parts between blanks in front of it.

    The vocabulary's normalizer and pre-tokenizer never join what a space or line feed parts, so a text's ids are those
    of its parts in order. Parts that aren't known go to the library many at a time, with a special token between them.
    Texts of Latin letters are lower-cased here already, as the normalizer does, so that fewer parts differ; but not those
    that hold what added tokens begin with, as these are looked for before normalizing, in their own case. Latin words,
    and the marks behind them, are pre-tokens by themselves: they go in without the normalizer, and each one's ids end
    with an id of the end-of-word kind."""

    MARK = "<|startoftext|>"

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), {}, most
        self.mark = self.tokenizer.token_to_id(self.MARK)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: what all added tokens begin with, as far as it has no case; '' stands in every text
        self.head = "".join(takewhile(lambda c: c.lower() == c.upper(), commonprefix(added))) if added else "\0\0"
        probe = "One <|endoftext|>two\n\nthree's  4á ́x ΑΣ Σ."
        for text in (probe, probe.upper(), "ÉTÉ 'S Don't x** a_b *x !!. straße|", ""):
            if self.mark is None or np.frombuffer(self.encode([text])[0], self.kind).tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("this vocabulary needs whole texts")

    def _latin(self, words: list[str], found: dict[str, bytes]) -> None:
        """Adds the ids of pre-tokens to found."""
        rows = [words[i : i + 512] for i in range(0, len(words), 512)]
        step = int(self.kind[2])
        for row, e in zip(rows, self.bare.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            data, start = ids.astype(self.kind).tobytes(), 0
            for word, end in zip(row, (np.flatnonzero(self.ends[ids]) + 1).tolist(), strict=True):
                found[word] = data[start * step : end * step]
                start = end

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts between blanks that aren't known yet."""
        words, other = [], []
        match = _WORD.fullmatch
        for p in parts:
            if (m := match(p)) and p == p.lower():
                words.append((p, *m.groups()))
            else:
                other.append(p)
        found: dict[str, bytes] = {"": b""}
        memo = self.memo
        self._latin(list({w for _, *pair in words for w in pair if w and w not in memo}), found)
        for p, word, marks in words:
            if marks:
                found[p] = (found[word] if word in found else memo[word]) + (found[marks] if marks in found else memo[marks])
        found.update(zip(other, self._marked(other)))
        return found

    def _marked(self, parts: list[str]) -> list[bytes]:
        alone = [p for p in parts if self.MARK in p]
        plain = [p for p in parts if self.MARK not in p] if alone else parts
        found = {p: np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, self.kind).tobytes() for p in alone}
        rows = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([self.MARK.join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            data, step, start = ids.astype(self.kind).tobytes(), int(self.kind[2]), 0
            for part, end in zip(row, ends, strict=True):
                found[part] = data[start * step : end * step]
                start = end + 1
        return [found[p] for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, in the width of `kind`."""
        head = self.head
        split = [(t if head in t or _NOT_LATIN.search(t) else t.lower()).replace("\n", " ").split(" ") for t in texts]
        known = self.memo
        if new := list(set(chain.from_iterable(split)).difference(known)):
            found = self._ids(new)
            if len(known) + len(found) <= self.most:
                known.update(found)
            else:  # a new memo, once this batch is done
                self.memo, known = found, known | found
        get = known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


@lru_cache(2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_store(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = 2, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the store of all rows; returns its manifest."""
    spark = docs.sparkSession
    files, folder = _filesystem(uri)
    files.create_dir(folder, recursive=True)
    rows = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shards = n_shards or _shards(rows)

    def run(batches):
        from pyspark import TaskContext

        encoder, writer, shard = chunk_encoder(tokenizer_path), None, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for first, texts in pieces(batch, "text", 2_000_000):
                keys = batch.column("doc_id").slice(first, len(texts)).to_pylist()
                if writer is None:
                    writer = ShardWriter(uri, f"shard-{shard:06d}.bin", len(end))
                for key, ids in zip(keys, encoder.encode([t or "" for t in texts])):
                    writer.add(key, ids + end)
        if writer is not None:
            n, ids = writer.close()
            row = {"shard": shard, "n_docs": n, "n_ids": ids, "first_key": writer.first, "last_key": writer.last, "n_last": writer.seen + 1}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), *((k, pa.int64()) for k in list(row)[1:])]))

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest, before, docs_before, open_key, open_n = [], 0, 0, None, 0
    made = mapped(dealt, run, "shard int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint, n_last bigint").collect()  # a row a shard
    for r in sorted(made, key=lambda r: r.shard):
        earlier = open_n if manifest and r.first_key == open_key else 0
        manifest.append({"shard": r.shard, "file": f"shard-{r.shard:06d}.bin", "n_docs": r.n_docs, "n_ids": r.n_ids, "first_id": before, "first_key": r.first_key, "last_key": r.last_key, "first_occurrence": earlier})
        before += r.n_ids
        docs_before += r.n_docs
        open_key, open_n = r.last_key, r.n_last + (earlier if r.first_key == r.last_key else 0)
    found = {"format": 1, "n_docs": docs_before, "n_ids": before, "shards": manifest}
    with files.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(found).encode())
    return found


def _shards(rows: DataFrame) -> int:
    """Shards by the size of what goes in; a small input still gets one for each core, of 1 MB or more."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // SHARD_BYTES), -(-n // SHARD_DOCS), min(4 * cores, size >> 20))


class TokenStore:
    """Keyed access to a whole store: the manifest tells the shard, its index the place."""

    def __init__(self, uri: str):
        self.uri, self.shards = uri, read_manifest(uri)["shards"]
        self.last = [_sorted_key(s["last_key"]) for s in self.shards]
        self.open: dict[str, ShardReader] = {}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of the document, or None if there is no such one."""
        at = bisect_left(self.last, _sorted_key(doc_id))
        for s in self.shards[at:]:
            if _sorted_key(s["first_key"]) > _sorted_key(doc_id):
                break
            here = occurrence - (s["first_occurrence"] if s["first_key"] == doc_id else 0)
            if here < 0:
                break
            if s["file"] not in self.open:
                self.open[s["file"]] = ShardReader(self.uri, s["file"])
            found = self.open[s["file"]].get(doc_id, here)
            if found is not None or s["last_key"] != doc_id:
                return found
        return None


def _sorted_key(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is not None, doc_id or 0


def read_manifest(uri: str) -> dict:
    files, folder = _filesystem(uri)
    with files.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_store(spark: SparkSession, uri: str) -> DataFrame:
    """Per document, read from the files through the index: doc_id, start, n_tokens, ids_crc32."""
    shards = read_manifest(uri)["shards"]
    rows = spark.createDataFrame([(s["file"], s["first_id"]) for s in shards], "file string, first_id bigint")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
                shard = ShardReader(uri, name)
                held = shard.slots
                # each document goes through the index: its key must lead to its own slot
                if not np.array_equal(shard.table.slots(held["fingerprint"]), np.arange(len(held))):
                    raise ValueError(f"{name}: the index doesn't lead to its documents")
                order = np.argsort(held["offset"], kind="stable")
                for at in range(0, len(order), 4096):
                    out = []
                    for row in held[order[at : at + 4096]]:
                        key = None if row["null"] else int(row["doc_id"])
                        if key_hash(key, int(row["occurrence"])) != int(row["fingerprint"]):
                            raise ValueError(f"{name}: document {key} has another fingerprint")
                        out.append((key, base + int(row["offset"]), int(row["n"]), zlib.crc32(shard.ids(row).tobytes())))
                    cols = zip(*out)
                    yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols)})

    return mapped(rows.repartition(max(1, len(shards)), "file"), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_uri(spark: SparkSession, name: str = "tokens") -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
