"""Token operators against the libraries whose vocabularies they read."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.queries import PIECES, WORDS, vocabulary
from tessera.llm.sentencepiece_codec import encode
from tessera.llm.token_counts import count_tokens, merger
from tessera.llm.token_pieces import hexdigest, piece_model
from tessera.llm.token_store import PerfectHash, ShardReader, TokenStore, chunk_encoder, key_hash, read_manifest, read_store, write_store

pytest.importorskip("public_tokenizers")


def texts(n=150, seed=2):
    r = random.Random(seed)
    pool = "  abcdetoinABC \n\t▁éß中日本語0123456789😀\x00'\".,<s>|*İΣς̀"
    out = ["".join(r.choice(pool) if r.random() < 0.85 else chr(r.randint(0x20, 0x9FFF)) for _ in range(r.randint(0, 120))) for _ in range(n)]
    out += ["", " ", "a" * 3000, " " * 77, "x" + " " * 40 + "y", "ab" * 700, "".join(r.choice("etaoinshr") for _ in range(2000)), "<|endoftext|> a<|startoftext|>b don't 'S x*** (a)", "Words, words. WORDS! étés"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (None, "null id"), (5000, None), (5001, "same"), (5001, "same"), (5001, "other")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, ids string, n_tokens int").repartition(4).cache()


def test_encoding_and_decoding(docs, rows):
    p = piece_model(vocabulary(PIECES)).processor
    want = Counter()
    for i, t in rows:
        ids = p.encode(t or "") + [p.eos_id()]
        want[i, len(ids), hexdigest(" ".join(map(str, ids)).encode()), hexdigest(p.decode(ids).encode())] += 1
    assert Counter(map(tuple, encode(docs, vocabulary(PIECES)).collect())) == want
    full = encode(docs, vocabulary(PIECES), ids=True).where("doc_id = 3").first()
    assert full.ids == p.encode(rows[3][1]) + [2] and full.decoded == p.decode(full.ids)
    assert encode(docs.limit(0), vocabulary(PIECES)).count() == 0


def test_counts(docs, rows):
    p = piece_model(vocabulary(PIECES)).processor
    want = Counter((i, len((t or "").encode()), n := len(p.encode(t or "")), n > 30) for i, t in rows)
    assert Counter(map(tuple, count_tokens(docs, vocabulary(PIECES), limit=30).collect())) == want
    assert Counter(map(tuple, count_tokens(docs, vocabulary(PIECES), limit=30, memo_size=5).collect())) == want
    assert count_tokens(docs.limit(0), vocabulary(PIECES)).count() == 0


def test_long_sequences_are_merged_exactly():
    m = merger(vocabulary(PIECES))
    r = random.Random(4)
    for k in range(60):
        t = "".join(r.choice("etaoinshr" if k % 3 else "ab") for _ in range(r.randint(60, 1500)))
        assert int(sum(m.units(m.model.units(t)))) == len(m.model.processor.encode(t))


def test_store_round_trip(spark, docs, rows, tmp_path):
    encoder = chunk_encoder(vocabulary(WORDS))
    uri = str(tmp_path / "store")
    write_store(docs, vocabulary(WORDS), uri, n_shards=3)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = {t: [e for e in encoder.tokenizer.encode(t or "", add_special_tokens=False).ids] + [2] for _, t in rows}
    found = sorted(map(tuple, read_store(spark, uri).collect()), key=lambda x: x[1])
    assert [f[0] for f in found] == [i for i, _ in order]
    assert sum(f[2] for f in found) == read_manifest(uri)["n_ids"] == sum(len(ids[t]) for _, t in rows)
    start, by_id = 0, {}
    for i, t in rows:
        by_id.setdefault(i, []).append((len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())))
    for i, at, n, crc in found:
        assert at == start and (n, crc) in by_id[i]
        by_id[i].remove((n, crc))
        start += n
    shards = [ShardReader(uri, s["file"]) for s in read_manifest(uri)["shards"]]
    for i, t in rows[:40]:
        hits = [s.get(i) for s in shards if s.find(i) is not None]
        assert len(hits) == 1 and hits[0].tolist() == ids[t]
    assert all(s.find(123456789) is None for s in shards)
    empty = str(tmp_path / "empty")
    assert write_store(docs.limit(0), vocabulary(WORDS), empty)["n_docs"] == 0 and read_store(spark, empty).count() == 0


def test_added_tokens_keep_their_case():
    e = chunk_encoder(vocabulary(WORDS))
    r = random.Random(5)
    pool = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "endoftext", "ENDOF", "a", "B", " ", "\n", "É", "'S", "*", "İ", "中", "Σ", "x1", "<", "|", ">", "the", "\u0301", "\xa0"]
    found = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(10_000)]
    for t, got in zip(found, e.encode(found)):
        assert np.frombuffer(got, e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_keyed_access_over_shards(spark, tmp_path):
    rows = [(None, "none"), (None, "none again"), *((i, f"text {i}") for i in range(-20, 60)), *((7, f"seven {k}") for k in range(120)), (2**40, "far"), (61, "word " * 200_000)]
    uri = str(tmp_path / "keyed")
    write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary(WORDS), uri, n_shards=6)
    store, e = TokenStore(uri), chunk_encoder(vocabulary(WORDS))
    assert len(store.shards) > 2 and sum(s["first_key"] <= 7 <= s["last_key"] for s in store.shards if s["first_key"] is not None) > 1
    for key in {i for i, _ in rows}:
        want = sorted(e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in rows if i == key)
        assert sorted(store.get(key, k).tolist() for k in range(len(want))) == want
        assert store.get(key, len(want)) is None
    assert store.get(123_456) is None and store.get(-10**9) is None and store.get(2**50) is None
    with pytest.raises(TypeError):
        write_store(spark.createDataFrame([("1", "a")], "doc_id string, text string"), vocabulary(WORDS), uri)


def test_perfect_hash():
    keys = np.array([key_hash(i) for i in range(5000)], np.uint64)
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    again, _ = PerfectHash.from_bytes(table.to_bytes(), len(table.levels))
    assert [again.slot(int(k)) for k in keys[:300]] == table.slots(keys[:300]).tolist()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], np.uint64))
