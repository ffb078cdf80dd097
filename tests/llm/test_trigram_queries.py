"""Trigram queries of random regexes: every string that a regex matches satisfies its query."""

import random
import re

from tessera.llm.secrets import RULES, trigram_query


def part(r, depth=0):
    """A regex and a function that makes one of its matches."""
    k = r.randrange(9 if depth < 3 else 5)
    if k < 2:
        word = "".join(r.choice("abcXYZ_9") for _ in range(r.randint(1, 5)))
        return word, lambda: word
    if k == 2:
        few = "".join(sorted(set(r.choice("abC-]^") for _ in range(r.randint(1, 4)))))
        return "[" + "".join(c if c.isalnum() else "\\" + c for c in few) + "]", lambda: r.choice(few)
    if k == 3:
        return r"[a-c0-9]", lambda: r.choice("abc0129")
    if k == 4:
        return r.choice([(r"\x2E", lambda: "."), (r"\-", lambda: "-"), (r"\d", lambda: "7"), (r"\.", lambda: "."), (".", lambda: "~"), (r"\t", lambda: "\t"), (r"[^a-f\]]", lambda: "z"), ("[]a]", lambda: "]"), ("[-a]", lambda: "-")])
    if k == 5:
        parts = [part(r, depth + 1) for _ in range(r.randint(2, 3))]
        return "(" + "|".join(p for p, _ in parts) + ")", lambda: r.choice(parts)[1]()
    if k == 6:
        p, make = part(r, depth + 1)
        quantifier, least, most = r.choice([("?", 0, 1), ("*", 0, 3), ("+", 1, 3), ("{2}", 2, 2), ("{1,3}", 1, 3), ("{2,}", 2, 4), ("{,2}", 0, 2), ("+?", 1, 2)])
        return f"(?:{p}){quantifier}", lambda: "".join(make() for _ in range(r.randint(least, most)))
    parts = [part(r, depth + 1) for _ in range(r.randint(2, 4))]
    return ("(?i:%s)" if k == 7 else "%s") % "".join(p if "|" not in p or p[0] == "(" else f"(?:{p})" for p, _ in parts), lambda: "".join(m() for _, m in parts)


def test_queries_hold_for_random_regexes():
    r = random.Random(11)
    asked = 0
    for _ in range(1500):
        regex, make = part(r)
        query = trigram_query(regex)
        asked += bool(query)
        for _ in range(5):
            text = make()
            assert re.fullmatch(regex, text, re.S), (regex, text)
            low = text.lower()
            assert all(any(all(g in low for g in grams) for grams in clause) for clause in query), (regex, text, query)
    assert asked > 300


def test_queries_of_the_rules():
    found = {kind: trigram_query(regex) for kind, regex, _ in RULES}
    assert found["access"] == [[frozenset({"aki", "kia"})]] and found["hex"] == [] and len(found["web_token"]) == 2
    assert trigram_query(r"abc(?=def)\bghi^jkl") == [[frozenset({"abc"})], [frozenset({"ghi"})], [frozenset({"jkl"})]]
