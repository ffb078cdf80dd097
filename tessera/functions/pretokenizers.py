"""Pre-tokenizers: text to pieces, each step a regex whose matches are the pieces."""

from __future__ import annotations

from collections.abc import Callable

from tessera.errors import UnsupportedTokenizerError

from . import unicode as U

#: pieces by behaviour, X the class that parts
_BY_BEHAVIOUR = {"removed": "[^X]+", "isolated": "[X]|[^X]+", "contiguous": "[X]+|[^X]+"}


def patterns(spec: dict | None, klass: Callable[[str], str] = U.char_class) -> list[str]:
    """The regexes of a `pre_tokenizer` section, one after the other; klass gives the body of a character class."""
    if spec is None:
        return []
    kind = spec.get("type")
    if kind == "Sequence":
        return [p for part in spec.get("pretokenizers", []) for p in patterns(part, klass)]
    if kind == "BertPreTokenizer":
        return [f"[{klass('punct')}]|[^{klass('space')}{klass('punct')}]+"]  # no mark of punctuation is a blank
    if kind == "WhitespaceSplit":
        return [f"[^{klass('space')}]+"]
    if kind == "Whitespace":
        return [f"[{klass('word')}]+|[^{klass('word')}{klass('space')}]+"]
    if kind == "Punctuation":
        how = str(spec.get("behavior", "Isolated")).lower()
        if how not in _BY_BEHAVIOUR:
            raise UnsupportedTokenizerError(f"punctuation behavior {spec.get('behavior')!r}")
        return [_BY_BEHAVIOUR[how].replace("X", klass("punct"))]
    if kind == "Digits":
        return [_BY_BEHAVIOUR["isolated" if spec.get("individual_digits", False) else "contiguous"].replace("X", klass("numeric"))]
    raise UnsupportedTokenizerError(f"pre_tokenizer {kind!r}")


def splits_on_blanks(spec: dict | None) -> bool:
    """No piece holds white space."""
    if spec is None:
        return False
    if spec.get("type") == "Sequence":
        return any(map(splits_on_blanks, spec.get("pretokenizers", [])))
    return spec.get("type") in ("BertPreTokenizer", "WhitespaceSplit", "Whitespace")


def compile_pre_tokenizer(spec: dict | None) -> Callable[[str], list[str]]:
    found = [U.compiled(p) for p in patterns(spec)]

    if len(found) == 1:
        return found[0].findall

    def split(text: str) -> list[str]:
        pieces = [text] if text else []
        for p in found:
            pieces = p.findall(pieces[0]) if len(pieces) == 1 else [x for piece in pieces for x in p.findall(piece)]
        return pieces

    return split
