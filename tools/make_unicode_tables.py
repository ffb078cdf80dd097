"""Write tessera/data/unicode.json: code point classes as the tokenizers library sees them.

Run once with that library installed; the engine reads the file only. Each class is a list of [first, last] ranges; `lower`
and the normalization forms hold the code points for which Python's own tables give something else.
"""

from __future__ import annotations

import json
import unicodedata
from pathlib import Path

from tokenizers import normalizers as N
from tokenizers import pre_tokenizers as P

POINTS = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


def ranges(points) -> list[list[int]]:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


def main() -> None:
    clean = N.BertNormalizer(clean_text=True, handle_chinese_chars=False, strip_accents=False, lowercase=False)
    bert_marks = N.BertNormalizer(clean_text=False, handle_chinese_chars=False, strip_accents=True, lowercase=False)
    strip, lower = N.StripAccents(), N.Lowercase()
    forms = {"NFC": N.NFC(), "NFD": N.NFD(), "NFKC": N.NFKC(), "NFKD": N.NFKD()}
    space, punct, digits, word = P.WhitespaceSplit(), P.Punctuation("isolated"), P.Digits(individual_digits=True), P.Whitespace()
    out: dict = {k: [] for k in ("clean_drop", "clean_space", "mark_nonspacing", "mark", "space", "punct", "numeric", "word")}
    out |= {"lower": {}, **{k: {} for k in forms}}
    for c in POINTS:
        x = chr(c)
        t = f"a{x}a"
        got = clean.normalize_str(t)
        if got == "aa":
            out["clean_drop"].append(c)
        elif got == "a a" and x != " ":
            out["clean_space"].append(c)
        if forms["NFD"].normalize_str(x) == x and bert_marks.normalize_str(t) == "aa":
            out["mark_nonspacing"].append(c)
        if strip.normalize_str(t) == "aa":
            out["mark"].append(c)
        if len(space.pre_tokenize_str(t)) == 2:
            out["space"].append(c)
        if len(punct.pre_tokenize_str(t)) == 3:
            out["punct"].append(c)
        if len(digits.pre_tokenize_str(t)) == 3:
            out["numeric"].append(c)
        if len(word.pre_tokenize_str(t)) == 1:
            out["word"].append(c)
        if (low := lower.normalize_str(x)) != x.lower():
            out["lower"][x] = low
        for name, form in forms.items():
            if (got := form.normalize_str(x)) != unicodedata.normalize(name, x):
                out[name][x] = got
    kept = {k: ranges(v) if isinstance(v, list) else v for k, v in out.items()} | {"python_unicode": unicodedata.unidata_version}
    target = Path(__file__).resolve().parent.parent / "tessera/data/unicode.json"
    target.write_text(json.dumps(kept, separators=(",", ":")) + "\n")
    print({k: len(v) for k, v in kept.items()}, target.stat().st_size)


if __name__ == "__main__":
    main()
