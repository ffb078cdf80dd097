"""Line dedup with a log-template tree of fixed depth.

Lines (parted by \\n) of at least MIN_TOKENS tokens go down a tree: first by their number of tokens, then by their LEADING
first tokens, where a token with a digit counts as a variable field. At a leaf all lines meet token by token: where they
differ there is a variable field. If LITERAL of the meeting's tokens are left, the leaf is one template, whatever stands
in its fields. The meeting is associative and idempotent, so tasks meet what they have first, and what a leaf gets of all
tasks is met in a tree of FAN branches, so no row gathers more than a small part of them.

A leaf whose meeting keeps too little is split: there each two lines that meet with LITERAL of their tokens left are of
one template, whatever else the leaf holds, and a line's template holds the line, its equals (digits aside) and all lines
it meets so. All such pairs are found: they differ in n - ceil(LITERAL n) tokens at most, so of one part of the tokens
more than that the lines have one part in common. Lines that share a part are compared with the first of them; those that
don't meet it are compared with all of the part.

Lines of fewer tokens, but MIN_CHARS characters or more (blanks between tokens count as one each), have no fields: each
is its own template, digits and all. So short boilerplate and lines of scripts without blanks are met if they are equal.

A template that stands in two documents or more is boilerplate or a copied passage: all its lines are dropped but the
first, by doc_id and line. Lines repeated within a single document only are left alone, as are those that are short in
tokens and characters.

What is shuffled: a fixed-size row for each line, the met templates of leaves that hold different lines, the different
lines of split leaves with a hash for each token and part, and once the texts with the lists of their dropped lines. Which leaves hold different lines is told to the tasks by a bitmap over
hashes of leaves, of a fixed size whatever the input; leaves that share a place with such a leaf
only cost some shuffling. Only a document's own lines are ever gathered in one row. The recurring templates are written
before lines are joined with them, so both sides are plain exchanges, which Spark splits where a template is frequent.

Defined results: a null text stays null, an empty one empty; null doc_ids count as documents of their own that come
first; rows that repeat id and text are one document for the counts and get the same result each; the columns of docs
stay as they are but for the text, and those that are named like the counts, which give way to these; an empty table
gives an empty result; doc_ids must be integers.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, integer_id, mapped, may_hold, pieces, removed, written

MIN_TOKENS, LEADING, LITERAL = 6, 3, 0.75
#: Least length of a line of fewer tokens.
MIN_CHARS = 20
FIELD = "<*>"
FAN = 1024
_DIGIT = re.compile(r"\d")
_VARIABLE = re.compile(r"\S*\d\S*")
#: Most leaves and about the characters of their meetings that a task holds at a time.
_HELD, _HELD_CHARS = 100_000, 8_000_000


def template(line: str) -> tuple[int, list[str]]:
    """Leaf and tokens, fields marked, of a line; no tokens if it is too short."""
    tokens = (_VARIABLE.sub(FIELD, line) if _DIGIT.search(line) else line).split()
    if len(tokens) < MIN_TOKENS:
        return 0, []
    return _signed(f"{len(tokens)} {' '.join(tokens[:LEADING])}"), tokens


def exact(line: str, min_chars: int = MIN_CHARS) -> tuple[int, list[str]]:
    """Leaf of its own and tokens of a line of few tokens; no tokens if it is too short in characters too."""
    tokens = line.split() if len(line) >= min_chars else []
    joined = " ".join(tokens)
    return (_signed(f"exact {joined}"), tokens) if len(joined) >= max(1, min_chars) else (0, [])


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _own(tokens: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(tokens).encode())


def met(a: list[str], b: list[str]) -> list[str]:
    return [x if x == y else FIELD for x, y in zip(a, b)]


def mixed_leaves(lines: DataFrame) -> DataFrame:
    """leaf, of the leaves that hold different lines; lines: leaf, own."""
    return lines.groupBy("leaf").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("leaf")


def leaf_templates(texts: DataFrame, mixed: bytes) -> DataFrame:
    """(leaf, template) of the leaves whose lines make one template with variable fields; texts: text."""
    bitmap = texts.sparkSession.sparkContext.broadcast(mixed)  # of a fixed size

    def run(batches):
        held: dict[int, str] = {}  # as text: lists of tokens take ten times as much
        chars = 0
        bits = bitmap.value

        def flush():
            out = pa.RecordBatch.from_pydict({"leaf": pa.array(held.keys(), pa.int64()), "template": pa.array(held.values(), pa.string())})
            held.clear()
            return out

        for batch in batches:
            for _, part in pieces(batch, "text"):
                for text in part:
                    for line in (text or "").split("\n"):
                        leaf, tokens = template(line)
                        if tokens and may_hold(bits, leaf) and (known := held.get(leaf)) != (whole := " ".join(tokens)):
                            held[leaf] = " ".join(met(known.split(" "), tokens)) if known else whole
                            chars += 0 if known else len(whole)
                    if len(held) >= _HELD or chars >= _HELD_CHARS:
                        yield flush()
                        chars = 0
        yield flush()

    found = mapped(texts, run, "leaf bigint, template string")
    for k in (F.pmod(F.xxhash64("template"), F.lit(FAN)), F.lit(0)):
        parts = found.groupBy("leaf", k.alias("branch")).agg(F.collect_set("template").alias("all"))
        tokens = F.transform("all", lambda t: F.split(t, " "))
        whole = F.aggregate(tokens, tokens[0], lambda acc, t: F.zip_with(acc, t, lambda a, b: F.when(a == b, a).otherwise(F.lit(FIELD))))
        found = parts.select("leaf", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.array_join(whole, " ")).alias("template"))
    found = found.select("leaf", F.split("template", " ").alias("t")).where(F.array_contains("t", FIELD))
    literal = F.size(F.filter("t", lambda x: x != FIELD))
    return found.where(literal >= F.ceil(LITERAL * F.size("t"))).select("leaf", F.array_join("t", " ").alias("template"))


def line_table(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, line, leaf, own) for each line that is long enough; rows: k1, k2, text."""

    def run(batches):
        for batch in batches:
            for first, part in pieces(batch, "text"):
                k1, k2 = (batch.column(k).slice(first, len(part)).to_pylist() for k in ("k1", "k2"))
                out = []
                for a, b, text in zip(k1, k2, part):
                    for n, line in enumerate((text or "").split("\n")):
                        leaf, tokens = template(line)
                        if not tokens:
                            leaf, tokens = exact(line, min_chars)
                        if tokens:
                            out.append((a, b, n, leaf, _own(tokens)))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_pydict({"k1": pa.array(cols[0], pa.int64()), "k2": pa.array(cols[1], pa.int64()), "line": pa.array(cols[2], pa.int32()), "leaf": pa.array(cols[3], pa.int64()), "own": pa.array(cols[4], pa.binary())})

    return mapped(rows, run, "k1 bigint, k2 bigint, line int, leaf bigint, own binary")


def parts_of(leaf: int, tokens: list[str]) -> list[int]:
    """Hashes of the parts of a line's tokens, of which lines that meet share one; a part with a field is in no meeting."""
    n = len(tokens)
    count = n - math.ceil(LITERAL * n) + 1
    shares = (tokens[LEADING + k :: count] for k in range(count))
    return [_signed(f"{leaf} {k} {' '.join(share)}") for k, share in enumerate(shares) if FIELD not in share]


def split_lines(texts: DataFrame, split: bytes) -> DataFrame:
    """(own, tokens, parts) for the lines of split leaves, with a hash of 8 bytes for each token, 0 for a field; texts: text."""
    bitmap = texts.sparkSession.sparkContext.broadcast(split)  # of a fixed size

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            for _, part in pieces(batch, "text"):
                held: dict[bytes, tuple[bytes, list[int]]] = {}
                for text in part:
                    for line in (text or "").split("\n"):
                        leaf, tokens = template(line)
                        if tokens and may_hold(bits, leaf) and (own := _own(tokens)) not in held:
                            codes = np.array([0 if t == FIELD else xxhash.xxh3_64_intdigest(t.encode()) for t in tokens], np.uint64)
                            held[own] = codes.tobytes(), parts_of(leaf, tokens)
                cols = list(zip(*held.values())) or [()] * 2
                yield pa.RecordBatch.from_pydict({"own": pa.array(held.keys(), pa.binary()), "tokens": pa.array(cols[0], pa.binary()), "parts": pa.array(cols[1], pa.list_(pa.int64()))})

    return mapped(texts, run, "own binary, tokens binary, parts array<bigint>").dropDuplicates(["own"])


def that_meet(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that meet with LITERAL of their tokens left; tokens: own, tokens."""
    for side in "ab":
        pairs = pairs.join(tokens.select(F.col("own").alias(side), F.col("tokens").alias(f"t{side}")), side)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            sizes = np.array([len(t) >> 3 for t in left])
            if any(len(x) != len(y) for x, y in zip(left, right)):
                raise ValueError("lines of one part differ in length")
            x, y = (np.frombuffer(b"".join(t), np.uint64) for t in (left, right))
            same = np.add.reduceat(((x == y) & (x != 0)).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
            yield batch.select(["a", "b"]).filter(pa.array(same >= np.ceil(LITERAL * sizes)))

    return mapped(pairs.select("a", "b", "ta", "tb"), run, "a binary, b binary")


def met_lines(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(a, b), both ways, of the lines of split leaves that meet; found: own, tokens, parts; templates: template, first."""
    tokens = found.select("own", "tokens")
    shared = found.select("own", F.explode("parts").alias("part")).join(templates.select(F.col("template").alias("own"), "first"), "own")
    shared = written(shared, "shared")
    leaders = written(shared.groupBy("part").agg(F.min(F.struct("first", "own")).alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    shared = written(shared.join(leaders, "part").select("part", "own", F.col("leader.own").alias("leader")), "parts")
    first = written(that_meet(shared.where("own <> leader").select(F.col("leader").alias("a"), F.col("own").alias("b")).distinct(), tokens), "meet")
    others = shared.where("own <> leader")
    rest = others.join(first.select(F.col("a").alias("leader"), F.col("b").alias("own")), ["leader", "own"], "left_anti").select("part", F.col("own").alias("x"))
    pairs = rest.join(others.select("part", F.col("own").alias("y")), "part").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = first.union(that_meet(pairs, tokens))
    return links.union(links.select("b", "a"))


def _dropped(rows: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, n_recurring, drop): of each document with lines of recurring templates, the lines that go."""
    table = written(line_table(rows, min_chars), "lines")
    mixed = written(mixed_leaves(table), "mixed")
    leaves = written(leaf_templates(rows.select("text"), bitmap(mixed)).select("leaf", F.lit(True).alias("one")), "leaves")
    split = bitmap(mixed.join(leaves, "leaf", "left_anti"))
    lines = table.join(leaves, "leaf", "left")
    lines = written(lines.select("k1", "k2", "line", F.when(F.col("one"), F.unhex(F.md5(F.col("leaf").cast("string").cast("binary")))).otherwise(F.col("own")).alias("template")), "templates")
    removed(table, mixed, leaves)
    place = F.struct("k1", "k2", "line")
    templates = lines.groupBy("template").agg(F.min(place).alias("first"), F.max(F.struct("k1", "k2")).alias("last"))
    if any(split):
        templates = written(templates, "places")
        links = met_lines(written(split_lines(rows.select("text"), split), "split"), templates)
        met = links.join(templates.withColumnRenamed("template", "b"), "b").select(F.col("a").alias("template"), "first", "last")
        templates = templates.union(met).groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    recurring = written(templates.where((F.col("first.k1") != F.col("last.k1")) | (F.col("first.k2") != F.col("last.k2"))).select("template", "first"), "recurring")
    found = lines.join(recurring, "template")
    later = F.when(F.col("first") != place, F.col("line"))
    return found.groupBy("k1", "k2").agg(F.count("*").alias("n_recurring"), F.collect_set(later).alias("drop"))  # a document's own lines


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, prefix: str = "line_dedup") -> DataFrame:
    """docs with the text less its dropped lines, and the columns <prefix>_n_lines, _n_recurring and _n_dropped.
    min_chars: least length of a line of fewer than MIN_TOKENS tokens."""
    counts = [f"{prefix}_{c}" for c in ("n_lines", "n_recurring", "n_dropped")]
    text = docs[text_col]
    key = F.coalesce(integer_id(docs, id_col), F.lit(-(1 << 63))), F.xxhash64(docs[id_col], text)
    drop = _dropped(docs.select(key[0].alias("k1"), key[1].alias("k2"), text.alias("text")), min_chars)
    kept = [c for c in docs.columns if c not in counts]
    all_rows = docs.join(drop, (key[0] == drop.k1) & (key[1] == drop.k2), "left")
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop["drop"])
    shorter = F.array_join(F.transform(F.array(lines), lambda all_lines: F.transform(left, lambda i: all_lines[i]))[0], "\n")
    columns = {c: F.when(F.size(drop["drop"]) > 0, shorter).otherwise(text) if c == text_col else docs[c] for c in kept}
    columns |= {
        counts[0]: F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
        counts[1]: F.coalesce(drop.n_recurring, F.lit(0)).cast("bigint"),
        counts[2]: F.when(drop["drop"].isNull(), 0).otherwise(F.size(drop["drop"])).cast("bigint"),
    }
    return all_rows.select(*(v.alias(k) for k, v in columns.items()))
