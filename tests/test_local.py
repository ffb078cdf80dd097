"""Goldens and the local interface, with tiny vocabularies."""

import json
import pickle

import numpy as np
import pytest

from tessera import BatchEncoding, RaggedIds, Tokenizer, UnsupportedTokenizerError
from tessera.functions.added_tokens import AddedToken, AddedTokens
from tessera.functions.decoders import Decoder
from tessera.functions.normalizers import compile_normalizer
from tessera.functions.pretokenizers import compile_pre_tokenizer
from tessera.functions.wordpiece import WordPiece
from tessera.sources.definitions import definition_from_vocab

IDS = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103, "hello": 7592, ",": 1010, "world": 2088, "!": 999, "una": 14477, "##ffa": 20961, "##ble": 3468, "one": 2028, "two": 2048, "three": 2093}


@pytest.fixture(scope="module")
def tok():
    made = json.loads(definition_from_vocab(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]))
    made["model"]["vocab"] = IDS
    for t in made["added_tokens"]:
        t["id"] = IDS[t["content"]]
    for t in made["post_processor"]["special_tokens"].values():
        t["ids"] = [IDS[t["id"]]]
    return Tokenizer.from_json(json.dumps(made))


def test_word_pieces():
    m = WordPiece({"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "a": 4, "##ff": 5, "é": 6, "##é": 7}, max_chars=10)
    assert [m.tokenize(w) for w in ("unaffable", "aff", "éé", "unx", "a" * 11)] == [[1, 2, 3], [4, 5], [6, 7], [0], [0]]
    assert m.tokenize("é" * 10) == [6] + [7] * 9
    assert WordPiece({"[UNK]": 0, "##x": 1, "a": 2}).tokenize("##x") == [1]
    with pytest.raises(ValueError):
        WordPiece({"a": 1})


def test_normalizer_and_pieces():
    n = compile_normalizer({"type": "BertNormalizer"})
    assert n("Héllo\0\tWörld 中文") == "hello world  中  文 "
    assert (n("a​b"), n("x\x0by\x0cz")) == ("ab", "xyz")
    assert compile_pre_tokenizer({"type": "BertPreTokenizer"})("Hey, you...  ok?") == "Hey , you . . . ok ?".split()
    assert compile_pre_tokenizer({"type": "Whitespace"})("Hey, you...ok?!") == "Hey , you ... ok ?!".split()
    assert compile_pre_tokenizer({"type": "Digits", "individual_digits": False})("ab123cd 45") == ["ab", "123", "cd ", "45"]


def test_added_tokens():
    a = AddedTokens([AddedToken(100, "[MASK]", lstrip=True, normalized=False), AddedToken(101, "[SEP]", rstrip=True, normalized=False), AddedToken(102, "cat", single_word=True, normalized=False)], lambda t: t)
    assert [a.split(t, a.raw) for t in ("a  [MASK] b", "[SEP]  x", "concat", "a cat.")] == [["a", 100, " b"], [101, "x"], ["concat"], ["a ", 102, "."]]


def test_decoder():
    d = Decoder(dict(type="WordPiece", cleanup=True, prefix="##"))
    assert d.decode("go ##od , he ' s .".split()) == "good, he ' s."
    assert d.decode(["##a", "b"]) == "##a b"
    assert Decoder(None).decode(["a", "b"]) == "a b"


def test_goldens(tok):
    assert tok.encode("Hello, world!", add_special_tokens=False).tolist() == [7592, 1010, 2088, 999]
    assert tok.encode("unaffable [MASK]", add_special_tokens=False).tolist() == [14477, 20961, 3468, 103]
    assert tok.encode(b"Hello world").tolist() == [101, 7592, 2088, 102]
    assert tok.decode([101, 7592, 1010, 2088, 999, 102], skip_special_tokens=True) == "hello, world!"
    assert tok.encode_batch(["one two three one two"], max_length=5).to_list() == [[101, 2028, 2048, 2093, 102]]
    assert tok.encode_batch_list(["one two three"], max_length=4, truncation_side="left") == [[101, 2048, 2093, 102]]
    assert tok.tokenize("one zzz") == ["one", "[UNK]"]
    with pytest.raises(ValueError, match="no room"):
        tok.encode_batch(["one"], max_length=1)
    for wrong in ("one", b"one"):
        with pytest.raises(TypeError, match="list of documents"):
            tok.encode_batch(wrong)
    with pytest.raises(TypeError, match="str or bytes"):
        tok.encode_batch([1])
    with pytest.raises(ValueError, match="invalid token id"):
        tok.decode([-1])
    assert len(tok.encode_batch([])) == 0


def test_padding(tok):
    out = tok.encode_batch_padded(["one", "one two three"], return_special_tokens_mask=True)
    assert out["input_ids"].tolist() == [[101, 2028, 102, 0, 0], [101, 2028, 2048, 2093, 102]]
    assert out["attention_mask"].tolist() == [[1, 1, 1, 0, 0], [1] * 5]
    assert out["special_tokens_mask"].tolist() == [[1, 0, 1, 1, 1], [1, 0, 0, 0, 1]]
    assert tok.encode_batch_padded(["one"], padding="max_length", max_length=6, padding_side="left")["input_ids"].tolist() == [[0, 0, 0, 101, 2028, 102]]
    assert tok.encode_batch_padded(["one"], pad_to_multiple_of=8)["input_ids"].shape == (1, 8)
    with pytest.raises(ValueError, match="longer than max_length"):
        tok.encode_batch_padded(["one", "one two three"], padding="max_length", max_length=4, truncation=False)


def test_ragged():
    r = RaggedIds.of([[1, 2], [], [3]])
    assert (len(r), r.num_tokens, r.lengths.tolist(), r.to_list()) == (3, 3, [2, 0, 1], [[1, 2], [], [3]])
    assert r[-1].tolist() == [3] and r[1:].to_list() == [[], [3]] and r[2:1].to_list() == []
    for bad in (3, -4):
        with pytest.raises(IndexError):
            r[bad]
    with pytest.raises(ValueError):
        r[::2]


def test_refused_definitions(tok, tmp_path):
    base = json.loads(tok.to_json())
    for part in ({"model": {"type": "BPE", "vocab": {}, "merges": []}}, {"normalizer": {"type": "Strip"}}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"decoder": {"type": "BPEDecoder"}}, {"post_processor": {"type": "TemplateProcessing", "single": []}}, {"pre_tokenizer": {"type": "Punctuation", "behavior": "MergedWithNext"}}):
        with pytest.raises(UnsupportedTokenizerError):
            Tokenizer.from_json(json.dumps(base | part))
    with pytest.raises(FileNotFoundError):
        Tokenizer("./nothing/here/at/all")
    with pytest.raises(TypeError):
        Tokenizer(3)
    (tmp_path / "tokenizer.json").write_text(tok.to_json())
    (tmp_path / "tokenizer_config.json").write_text('{"model_max_length": 7, "pad_token": {"content": "[PAD]"}}')
    for where in (tmp_path, tmp_path / "tokenizer.json"):
        assert Tokenizer(where).config == {"model_max_length": 7, "pad_token": "[PAD]"}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/vocab.txt").write_text("[UNK]\n[CLS]\n[SEP]\na\na\n")
    (tmp_path / "v/tokenizer_config.json").write_text('{"do_lower_case": false}')
    t = Tokenizer(tmp_path / "v")
    assert t.encode("a A").tolist() == [1, 4, 0, 2]
    assert Tokenizer(t).spec is t.spec and Tokenizer.from_vocab(tmp_path / "v/vocab.txt").encode("A").tolist() == [1, 4, 2]


def test_call_style(tok):
    hf = tok.as_hf()
    out = hf(["one", "one two three"], padding=True, truncation=True, max_length=4, return_tensors="np", return_length=True)
    assert out.input_ids.tolist() == [[101, 2028, 102, 0], [101, 2028, 2048, 102]] and out.length.tolist() == [4, 4]
    assert hf("one two").input_ids == [101, 2028, 2048, 102] and hf.encode("one", add_special_tokens=False) == [2028]
    assert hf("one two three", max_length=3)["input_ids"] == [101, 2028, 102]
    assert list(hf("one", return_token_type_ids=False)) == ["input_ids", "attention_mask"]
    for name in ("text_pair", "is_split_into_words", "return_offsets_mapping", "return_overflowing_tokens"):
        with pytest.raises(NotImplementedError):
            hf("one", **{name: True})
    for bad in ({"padding": "x"}, {"truncation": "x"}, {"truncation": "only_second", "max_length": 3}, {"padding": True, "truncation": True, "max_length": 7, "pad_to_multiple_of": 8}, {"max_length": 1}):
        with pytest.raises(ValueError):
            hf("one two three", **bad)
    with pytest.raises(ValueError):
        hf(None)
    with pytest.raises(NotImplementedError):
        hf("one", return_tensors="tf")
    assert hf.pad({"input_ids": [[1], [1, 2, 3]]}) == {"input_ids": [[1, 0, 0], [1, 2, 3]], "attention_mask": [[1, 0, 0], [1, 1, 1]]}
    assert hf.pad([{"input_ids": [1], "x": 5}], pad_to_multiple_of=4)["input_ids"] == [[1, 0, 0, 0]]
    assert hf.decode(7592) == "hello" and hf.batch_decode([[7592], [2088, 999]]) == ["hello", "world!"]
    assert hf.convert_tokens_to_ids(["hello", "nope"]) == [7592, 100] and hf.convert_ids_to_tokens([101, 7592], skip_special_tokens=True) == ["hello"]
    assert hf.convert_tokens_to_string(["una", "##ffa", "!"]) == "unaffa!" and hf.tokenize("one", add_special_tokens=True) == ["[CLS]", "one", "[SEP]"]
    assert (hf.cls_token, hf.cls_token_id, hf.bos_token, hf.bos_token_id, len(hf), hf.num_special_tokens_to_add()) == ("[CLS]", 101, None, None, 15, 2)
    assert hf.all_special_ids == [100, 102, 0, 101, 103] and str(hf.added_tokens_decoder[103]) == "[MASK]"
    uneven = hf(["one", "one two"], return_tensors="np").input_ids
    assert uneven.dtype == object and isinstance(uneven[0], np.ndarray)
    hf.pad_token = None
    with pytest.raises(ValueError):
        hf("one", padding=True)
    again = pickle.loads(pickle.dumps(BatchEncoding(a=1)))
    assert again.a == 1 and isinstance(again, BatchEncoding)
    with pytest.raises(AttributeError):
        _ = again.b


def test_option_grid(tok):
    """All combinations run or raise the documented kinds of errors, and padded rows are rectangular."""
    hf = tok.as_hf()
    texts = ["one", "one two three one two three", ""]
    for padding in (False, True, "longest", "max_length"):
        for truncation in (None, True, False, "only_first", "only_second"):
            for max_length in (None, 1, 2, 3, 16):
                for multiple in (None, 8):
                    for side in ("right", "left"):
                        try:
                            out = hf(texts, padding=padding, truncation=truncation, max_length=max_length, pad_to_multiple_of=multiple, padding_side=side)
                        except ValueError:
                            continue
                        rows = out["input_ids"]
                        assert all(len(r) == len(m) for r, m in zip(rows, out["attention_mask"]))
                        if padding in (True, "longest"):
                            assert len({len(r) for r in rows}) == 1 and (not multiple or len(rows[0]) % multiple == 0)
                        if truncation in (True, "only_first") and max_length and not padding:
                            assert all(len(r) <= max_length for r in rows)


def test_memo(tok):
    small = Tokenizer(tok)
    small.set_cache_entries(1)
    assert small.encode_batch_list(["one two", "two one"]) == tok.encode_batch_list(["one two", "two one"])
    small.clear_cache()
    with pytest.raises(ValueError):
        small.set_cache_entries(0)


def test_cuts_and_memos_never_change_ids():
    import random
    import re

    from tessera.plans import spec as S
    from tessera.plans.queries import spec

    from .texts import ALL

    run, r = spec().runtime, random.Random(6)
    plain = S.Runtime(run.definition, 1)
    blanks = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert blanks == {*" \t\n\r", *S._OTHER_BLANKS, *S._WIDE_BLANKS}
    odd = ["a\x0bb c\x0cd", "a\x1cb \x1d c", "x\x85y\xa0z", "u\u2028v\u3000w \u1680", "é\xa0É ", "\xb4 ½ ÿ ß\xad"]
    for t in [*ALL, *odd]:
        assert run.normalized(t) == run.normalize(t)
        assert S.chunks(t) == re.findall(r"[^ \t\n\r]+", t)
        want = [i for p in plain.added.split(t, plain.added.raw) for i in ([p] if isinstance(p, int) else [i for w in plain.pre_tokenize(plain.normalize(p)) for i in plain.model.tokenize(w)])]
        assert run.encode(t) == plain.encode(t) == want
        for room in (0, 1, 3, 20):
            assert list(memoryview(run.encode_some(t, room)).cast("i")) == want[:room]
            assert list(memoryview(run.encode_some(t, room, "left")).cast("i")) == want[max(0, len(want) - room) :]
    long = " ".join(r.choice(ALL) for _ in range(3000))
    whole = run.encode(long)
    for size in (1 << 10, 1 << 16):
        S.AT_ONCE, before = size, S.AT_ONCE
        assert run.encode(long) == whole
        S.AT_ONCE = before
    for room in (5, 500):
        assert list(memoryview(run.encode_some(long, room)).cast("i")) == whole[:room]
        assert list(memoryview(run.encode_some(long, room, "left")).cast("i")) == whole[-room:]
    assert len(plain._chunks) <= 1


def test_names_in_the_local_cache(tmp_path, monkeypatch):
    from tessera import Tokenizer
    from tessera.plans.queries import spec

    monkeypatch.setenv("HF_HUB_CACHE", str(tmp_path))
    model = tmp_path / "models--some--model"
    (model / "refs").mkdir(parents=True)
    (model / "refs" / "main").write_text("abc\n")
    for snapshot in ("abc", "def"):
        (model / "snapshots" / snapshot).mkdir(parents=True)
        (model / "snapshots" / snapshot / "tokenizer.json").write_text(spec().text)
    (model / "snapshots" / "def" / "tokenizer_config.json").write_text('{"model_max_length": 7}')
    assert Tokenizer("some/model").config == {} and Tokenizer("some/model", revision="def").config == {"model_max_length": 7}
    for name in ("some/other", "a/b/c", "./some/model"):
        with pytest.raises(FileNotFoundError):
            Tokenizer(name)
    tok = Tokenizer("some/model")
    for parallel in (None, True, False):
        assert tok.encode_batch(["the", "of"], parallel=parallel).to_list() == tok.encode_batch_list(["the", "of"], parallel=parallel)
        assert tok.encode_batch_padded(["the", "of the"], parallel=parallel)["input_ids"].shape == (2, 4)
    assert tok.backend is tok.runtime


def test_half_a_surrogate_pair_is_no_string():
    from tessera.sources.files import extract_field

    with pytest.raises(ValueError, match="invalid JSONL line"):
        extract_field('{"text": "\\ud800"}')
    assert extract_field('{"text": "\\ud83d\\ude42"}') == "🙂"
