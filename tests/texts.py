"""Texts that are hard on Unicode handling, written for these tests, and seeded random ones."""

import random

HARD = [
    "Hello, world!", "Héllo Wörld naïve façade", "áè ü ́x", "中文和English混排", "日本語テキスト 한국어", "𠀀𠀁 𪜀 \U0002b820 \U0002b920",
    "👩‍👩‍👧 🙂🙃 ☕️", "zero​width‍join﻿er", "ctrl\x00a\x01b\x7fc\x0bd\x0ce\x1ff", "tabs\tand\nlines\r\nend", "nb\xa0space em　wide line\x85next",
    "ΟΔΟΣ ΣΑΣ Σ σς", "İstanbul ıI", "Straße ẞ", "ﬁne ﬀ ﾊﾝｶｸ ＡＢＣ x²", "العربية שָׁלוֹם हिन्दी ไทย", "x" * 100, "x" * 101, "y" * 300 + " z",
    "[MASK] in [CLS] text [SEP]", "a[MASK]b [mask]", "!?.,;:'\"()[]{}<>@#$%^&*-_=+|~`/\\", "…—–“”‘’«»", "http://a.b/c?d=e&f=1.5", "def f(x): return x**2", "3.14 1,000 ½ Ⅷ ٣",
    "  lead and trail  ", "", " ", "\n\t", "don't it's we'll", "private �", "⠃⠗ ∑∫√", "㐀 豈 你好", "𝐛𝐨𝐥𝐝 𝓯𝓪𝓷", "ÅB ͅ", "##ly ly##ly", "ĳ ŉ ǆ", "᠎⁠­ soft",
]


def random_texts(n=200, seed=5):
    r = random.Random(seed)
    pools = ["abcdefghijklmnop", "ABCXYZ", "0123456789", "  \t\n", ".,!?'-", "éüñßçÅİΣ", "中文日本", "́̈​\x00\x0b"]
    out = []
    for i in range(n):
        chars = [r.choice(r.choices(pools, [8, 2, 1, 4, 2, 2, 1, 1])[0]) if r.random() < 0.92 else chr(r.choice([r.randint(0x80, 0x3000), r.randint(0xF900, 0x2FFFF)])) for _ in range(r.randint(0, 90))]
        text = "".join(c for c in chars if not 0xD800 <= ord(c) <= 0xDFFF)
        if i % 11 == 0:
            text = text[:20] + r.choice(["[MASK]", " [SEP] ", "[CLS]x"]) + text[20:]
        out.append(text)
    return out


ALL = HARD + random_texts()
