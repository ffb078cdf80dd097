"""Normalizer steps: text to text."""

from __future__ import annotations

from collections.abc import Callable

from tessera.errors import UnsupportedTokenizerError

from . import unicode as U

Step = Callable[[str], str]
_ASCII_CLEAN = {c: None for c in [*range(9), 11, 12, *range(14, 32), 127]} | {9: " ", 10: " ", 13: " "}


def clean_text(text: str) -> str:
    """Controls go (also U+000B and U+000C, which joins what they parted), other blanks become spaces."""
    if text.isascii():
        return text.translate(_ASCII_CLEAN)
    text = U.compiled(f"[{U.char_class('clean_drop')}]+").sub("", text)
    return U.compiled(f"[{U.char_class('clean_space')}]").sub(" ", text)


def space_ideographs(text: str) -> str:
    return text if text.isascii() else U.compiled(f"([{U.IDEOGRAPH_CLASS}])").sub(r" \1 ", text)


def strip_bert_accents(text: str) -> str:
    """Decompose, then drop nonspacing marks."""
    return text if text.isascii() else U.compiled(f"[{U.char_class('mark_nonspacing')}]+").sub("", U.normal_form("NFD", text))


def strip_marks(text: str) -> str:
    """Drop all marks, without decomposing."""
    return text if text.isascii() else U.compiled(f"[{U.char_class('mark')}]+").sub("", text)


def _form(name: str) -> Step:
    return lambda text: U.normal_form(name, text)


_PLAIN: dict[str, Step] = {n: _form(n) for n in ("NFC", "NFD", "NFKC", "NFKD")} | {"Lowercase": U.lower, "StripAccents": strip_marks}


def steps(spec: dict | None) -> list[Step]:
    """The steps of a `normalizer` section."""
    if spec is None:
        return []
    kind = spec.get("type")
    if kind == "Sequence":
        return [s for part in spec.get("normalizers", []) for s in steps(part)]
    if kind in _PLAIN:
        return [_PLAIN[kind]]
    if kind != "BertNormalizer":
        raise UnsupportedTokenizerError(f"normalizer {kind!r}")
    on = spec.get
    low = on("lowercase", True)
    accents = on("strip_accents")
    chosen = [(on("clean_text", True), clean_text), (on("handle_chinese_chars", True), space_ideographs), (low if accents is None else accents, strip_bert_accents), (low, U.lower)]
    return [f for wanted, f in chosen if wanted]


def compile_normalizer(spec: dict | None) -> Step:
    todo = steps(spec)

    def normalize(text: str) -> str:
        for step in todo:
            text = step(text)
        return text

    return normalize
