"""Ids, decoding and pieces against the tokenizers library, which serves as the judge here and nowhere else."""

import json
from pathlib import Path

import pytest

from tessera.functions.unicode import char_class, compiled
from tessera.sources.definitions import definition_from_vocab, read_vocab
from tessera.tokenizer import Tokenizer

from .texts import ALL

tokenizers = pytest.importorskip("tokenizers")
VOCAB = Path(__file__).resolve().parent.parent / "tessera/data/vocab.txt"
BASE = json.loads(definition_from_vocab(read_vocab(VOCAB)))
BERT = {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True}


def variant(**parts):
    return json.dumps(BASE | parts)


def same(definition, texts=ALL):
    ours, judge = Tokenizer.from_json(definition), tokenizers.Tokenizer.from_str(definition)
    for special in (True, False):
        want = [e.ids for e in judge.encode_batch(texts, add_special_tokens=special)]
        got = ours.encode_batch_list(texts, add_special_tokens=special)
        bad = [(t, a, b) for t, a, b in zip(texts, got, want) if a != b]
        assert not bad, bad[:2]
        for skip in (True, False):
            assert ours.decode_batch(got, skip_special_tokens=skip) == judge.decode_batch(want, skip_special_tokens=skip)


NORMALIZERS = [
    None, BERT, BERT | {"lowercase": False}, BERT | {"strip_accents": False}, BERT | {"clean_text": False}, BERT | {"handle_chinese_chars": False, "strip_accents": True, "lowercase": False},
    *({"type": t} for t in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")), {"type": "Sequence", "normalizers": [{"type": "NFKD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]},
]
PRE = [
    None, {"type": "BertPreTokenizer"}, {"type": "WhitespaceSplit"}, {"type": "Whitespace"}, *({"type": "Punctuation", "behavior": b} for b in ("Isolated", "Contiguous", "Removed")),
    *({"type": "Digits", "individual_digits": b} for b in (True, False)), {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}, {"type": "Punctuation", "behavior": "Contiguous"}]},
]


@pytest.mark.parametrize("normalizer", NORMALIZERS, ids=str)
def test_normalizers(normalizer):
    same(variant(normalizer=normalizer))


@pytest.mark.parametrize("pre", PRE, ids=str)
def test_pre_tokenizers(pre):
    same(variant(pre_tokenizer=pre))


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"lstrip": True, "rstrip": True}, {"single_word": True}, {"normalized": True}], ids=str)
def test_added_token_flags(flags):
    mask = {"id": 4, "content": "[MASK]", "special": True, "normalized": False, "single_word": False, "lstrip": False, "rstrip": False} | flags
    same(variant(added_tokens=[t for t in BASE["added_tokens"] if t["id"] != 4] + [mask]), [*ALL, "x [MASK] y", "a  [MASK]  [MASK]b", "[MASK][MASK] _[MASK] é[MASK]"])


def test_plain_added_tokens():
    ids = dict(BASE["model"]["vocab"])
    more = [{"id": ids.setdefault(c, len(ids)), "content": c, "special": c[0] == "<", "normalized": c[0] != "<", "single_word": False, "lstrip": False, "rstrip": False} for c in ["open door", "Größe", "日本", "##ness", "<ent>"]]
    same(variant(added_tokens=BASE["added_tokens"] + more), [*ALL, "Open door open  door", "die GRÖSSE Größe grösse grosse", "x日本y 日 本", "kindly ##ness", "a<ent>b <ENT>"])


def test_decoder_without_section():
    same(variant(decoder=None))


def test_every_code_point_of_the_classes():
    """One look at each assigned plane: class membership against the library."""
    split = tokenizers.pre_tokenizers.Punctuation("isolated")
    mine = compiled(f"[{char_class('punct')}]")
    for c in [*range(0x3000), *range(0xFE00, 0x11000, 7)]:
        if not 0xD800 <= c <= 0xDFFF:
            assert bool(mine.match(chr(c))) == (len(split.pre_tokenize_str(f"a{chr(c)}a")) == 3)
