"""Secret scan by trigram queries over a document's postings, in DataFrame functions only.

trigram_query() derives from each rule's regex a Boolean query: every match, lower-cased, holds all trigrams of one of
each clause's alternatives. holds() intersects the postings of these trigrams for a document: whether a document is in a
trigram's postings is asked of its own lower-cased text, trigram by trigram, and the first one missing ends it. So the
index lies where the texts are: nothing is shuffled, joined or gathered, and a frequent trigram makes no hot group. Only
the rules whose query holds are verified with their regex. A rule without mandatory trigrams scans every text in full.
The query and the pattern are prepared on the driver; no Python runs on the executors.

Matches are leftmost and non-overlapping for each kind; positions are code points, end exclusive. They are taken from
what a split by the regex leaves between the matches.

Defined results: a null text counts as empty; null and repeated doc_ids pass through, a row for each row; other columns
are ignored; an empty table gives an empty result. Spans that start together are ordered by the order of RULES.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, regex (the same in Python and Java), least length of group 2 or 0; the first three are the base.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0),
    ("payment", r"sk_live_[A-Za-z0-9]{16,}", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("uri_login", r"[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", 0),
]
BASE = ("assign", "access", "hex")

_MOST = 64


#: Escapes that stand for one character.
_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_REPEAT = re.compile(r"([*+?]|\{(\d*)(?:(,)(\d*))?\})[?+]?")


class _Pattern:
    """A regex as alternatives, each a list of items: ("one", characters) for one character of a few, lower-cased,
    ("any",) for what isn't known, ("group", alternatives), ("repeat", least, most or None, item)."""

    def __init__(self, regex: str):
        self.text, self.at = regex, 0
        self.alternatives = self._alternatives()
        if self.at < len(regex):
            raise ValueError(f"a bracket is closed that isn't open: {regex!r}")

    def _alternatives(self) -> list[list[tuple]]:
        out: list[list[tuple]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.at += 1
                out.append([])
                continue
            item = self._item()
            if (m := _REPEAT.match(self.text, self.at)) and (m[1] in "*+?" or m[2] or m[4]):
                self.at = m.end()
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[1]) or (int(m[2] or 0), (int(m[4]) if m[4] else None) if m[3] else int(m[2]))
                item = "repeat", least, most, item
            out[-1].append(item)
        return out

    def _item(self) -> tuple:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            kind = re.compile(r"\?(?:[aiLmsux-]*:|P<\w+>)").match(self.text, self.at)
            known = kind or self.text[self.at] != "?"
            self.at = kind.end() if kind else self.at
            inner = self._alternatives()
            self.at += 1
            return ("group", inner) if known else ("any",)  # what only looks around isn't read
        if c == "[":
            return self._set()
        if c == "\\":
            found = self._escape()
            return ("one", {found.lower()}) if found else ("any",)
        return ("any",) if c in ".^$" else ("one", {c.lower()})

    def _escape(self) -> str | None:
        """The character that an escape stands for, or None if it stands for more or for none."""
        c = self.text[self.at]
        self.at += 1
        if c in "xuU" and (m := re.compile("[0-9a-fA-F]{%d}" % {"x": 2, "u": 4, "U": 8}[c]).match(self.text, self.at)):
            self.at = m.end()
            return chr(int(m[0], 16))
        return _CONTROL.get(c) if c.isalnum() else c

    def _set(self) -> tuple:
        start, few, held = self.at, True, set()
        if self.text[self.at] == "^":
            few, self.at = False, self.at + 1
        first = self.at
        while self.text[self.at] != "]" or self.at == first:
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                found = self._escape()
                few &= found is not None
                held.add((found or "").lower())
            elif c == "-" and self.at - 1 not in (start, first) and self.text[self.at] != "]":
                few = False  # a range
            else:
                held.add(c.lower())
        self.at += 1
        return ("one", held) if few and len(held) <= 5 else ("any",)


def _literals(items: list[tuple]) -> set[str] | None:
    """All strings that items in a row can match, lower-cased; None if they are many or unknown."""
    out = {""}
    for item in items:
        if item[0] == "one":
            part = item[1]
        elif item[0] == "group":
            parts = [_literals(x) for x in item[1]]
            part = None if None in parts else set().union(*parts)
        elif item[0] == "repeat" and item[2] is not None and item[2] <= 4:
            inner = _literals([item[3]])
            part = None if inner is None else {"".join(p) for n in range(item[1], item[2] + 1) for p in product(inner, repeat=n)} if len(inner) ** item[2] <= _MOST else None
        else:
            part = None
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _flat(items: list[tuple]):
    """Items in a row, groups without alternatives opened."""
    for item in items:
        if item[0] == "group" and len(item[1]) == 1:
            yield from _flat(item[1][0])
        else:
            yield item


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Clauses, all of which hold for a text with a match: one of the clause's sets of trigrams is there in full."""
    clauses: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def close():
        nonlocal run
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in grams:
            least = [g for g in grams if not any(h < g for h in grams)]
            clauses.append(sorted(least, key=sorted))
        run = {""}

    for item in _flat([("group", _Pattern(regex).alternatives)]):
        part = _literals([item])
        if part is None or len(part) * len(run) > _MOST:
            close()
            if part is not None:
                run = part
            elif item[0] == "repeat" and item[1] >= 1 and (inner := _literals([item[3]])) is not None:
                run = inner
                close()
        else:
            run = {a + b for a in run for b in part}
    close()
    return clauses


def _spans(text: Column, regex: str, least: int, candidate: Column) -> Column:
    """array<struct<start, end>> of a candidate's matches, those with too short a group 2 left out."""
    between = F.split(text, regex, -1)
    match = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    size = F.regexp_extract_all(text, F.lit(regex), F.lit(2)) if least else match
    parts = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(match)), F.length).alias("gap"), F.transform(match, F.length).alias("n"), F.transform(size, F.length).alias("value"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (F.concat(acc["out"], F.when(x["value"] >= least, one).otherwise(none)) if least else F.concat(acc["out"], one)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(candidate & F.rlike(text, F.lit(regex)), found).otherwise(none)


def holds(low: Column, query: list[list[frozenset[str]]]) -> Column:
    """Whether a lower-cased text is in the intersection of postings that the query asks for."""
    out = F.lit(True)
    for clause in query:
        either = F.lit(False)
        for grams in clause:
            every = F.lit(True)
            for g in sorted(grams):
                every &= F.contains(low, F.lit(g))
            either |= every
        out &= either
    return out


def scan(docs: DataFrame, rules=RULES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> of the base kinds, base_sha256, spans (string), found (array of kind, start, end)."""
    queries = {kind: trigram_query(regex) for kind, regex, _ in rules}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", "text", *(holds(F.col("low"), q).alias(f"may_{kind}") for kind, q in queries.items()))
    order = {k: i for i, (k, _, _) in enumerate(rules)}

    def spans_of(kind, regex, least):
        found = _spans(F.col("text"), regex, least, F.col(f"may_{kind}"))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    rows = rows.select("doc_id", F.array_sort(F.concat(*(spans_of(*r) for r in rules))).alias("all"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("all", lambda s: s["kind"] == kind)

    return rows.select(
        "doc_id",
        *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("all", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )
