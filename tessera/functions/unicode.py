"""Code point classes and mappings of the tokenizer definitions (data/unicode.json, see tools/make_unicode_tables.py)."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from importlib import resources


@lru_cache(1)
def tables() -> dict:
    return json.loads(resources.files("tessera").joinpath("data/unicode.json").read_text())


@lru_cache(32)
def char_class(name: str) -> str:
    """Body of a regex character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in tables()[name])


@lru_cache(32)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


#: The classes in Java's regexes with (?U). They follow the JVM's Unicode version, so they differ from the tables above
#: for some code points assigned of late (and two marks of punctuation); the tables are exact.
JAVA_CLASSES = {"space": r"\s", "word": r"\w", "numeric": r"\p{N}", "punct": r"\p{P}$+<=>^`|~"}


@lru_cache(8)
def _exceptions(form: str) -> re.Pattern | None:
    held = "".join(map(re.escape, tables()[form]))
    return re.compile(f"([{held}])") if held else None


def normal_form(form: str, text: str) -> str:
    if text.isascii():
        return text
    apart = _exceptions(form)
    if apart is None or not apart.search(text):
        return unicodedata.normalize(form, text)
    other = tables()[form]
    return "".join(other[part] if part in other else unicodedata.normalize(form, part) for part in apart.split(text))


@lru_cache(1)
def _special_case() -> re.Pattern:
    return re.compile("[Σ" + "".join(map(re.escape, tables()["lower"])) + "]")


def lower(text: str) -> str:
    """Lower case of each character by itself, without a rule for final sigma."""
    if text.isascii() or not _special_case().search(text):
        return text.lower()
    other = tables()["lower"]
    return "".join(other[c] if c in other else c.lower() for c in text)


#: Ideographs that are set apart; the block at 2B820 is not among them, by definition.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
IDEOGRAPH_CLASS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in IDEOGRAPHS)
