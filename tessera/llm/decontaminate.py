"""Benchmark decontamination by template windows.

Texts of documents and benchmark items become tokens: numbers, units after a number and names (capitalised words inside
a sentence) turn into typed placeholders, the rest is lower-cased and loses its outer punctuation. Windows of WINDOW
tokens with at least LITERAL literal ones are hashed and hash-joined with those of the items. Matches of one document and
item that lie on one diagonal (place in the document less place in the item) are an alignment; its slots are checked: a
placeholder value of the item must stand for one value in the document throughout and the other way round, or the
windows that disagree are dropped. If consistent windows of alignments within one stretch of the document cover SHARE of
the item's windows, the document is contaminated: also by a question with other numbers. Each place of the document
stands for one place of the item and the other way round, so a few repeated words don't cover an item that repeats them.

An item of fewer than WINDOW tokens is one window of all it has, and found as a line of its own (which begins a sentence).
One of LITERAL tokens or more is found anywhere in a text as well; shorter ones may stand in any text by chance. Items without a window of enough
literal tokens are left out.

The items are a hash table on the executors while their words and bytes are at most BROADCAST_WINDOWS and
BROADCAST_BYTES; beyond either, the windows of documents and items meet in a shuffled hash join. It only picks the pairs
to look at, by a bound that each contaminated pair keeps, and Items.search() decides on them as it does for the table, so
both ways give the same rows.

Defined results: a null text has no tokens and is never contaminated; null and repeated doc_ids pass through, a row for
each row; an item_id with several texts is found by each of them and counts once; null item texts and ids are left out;
other columns are ignored; an empty table of documents gives an empty result, one of items leaves all documents clean;
item_ids must be integers.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import integer_id, mapped, pieces, written

WINDOW, LITERAL, SHARE = 5, 3, 0.8
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 4 << 20
NUMBER, UNIT, NAME = "\x00n", "\x00u", "\x00p"
UNITS = frozenset("mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres g kg mg lb lbs oz ton tons gram grams kilogram kilograms pound pounds s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons km/h mph kmh % percent dollar dollars euro euros cent cents usd eur $ € £ °c °f degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,]*(%|[a-zA-Z/°]{1,4})?$")
_OUTER = ".,;:!?\"'()[]{}«»“”‘’…"
_CLOSED = re.compile(r"[.!?][\"')\]”]+$")
_U = np.uint64


_PLAIN, _CAPITAL, _NUM, _NUM_UNIT, _NOTHING, _UNIT = range(6)


class _Forget(dict):
    """A memo that keeps nothing."""

    def __len__(self) -> int:
        return 1 << 60


_FORGET = _Forget()


class Words(dict):
    """What a word is by itself: kind, lower-cased form, slot value, unit, and whether it ends a sentence."""

    def __missing__(self, raw: str) -> tuple[int, str, str, str, bool]:
        word = raw.strip(_OUTER)
        ends = raw[-1] in ".!?" or bool(_CLOSED.search(raw))
        low = word.lower()
        if not word:
            out = _NOTHING, "", "", "", raw[-1] in ".!?"
        elif (word[0].isdigit() or word[0] in "+-$€£") and (m := _NUMBER.match(word)):
            out = (_NUM_UNIT, low, word[: m.start(1)], m[1].lower(), ends) if m[1] else (_NUM, low, word, "", ends)
        elif low in UNITS:
            out = _UNIT, low, low, "", ends
        elif low != word and word[0].isupper() and not word.isupper():
            out = _CAPITAL, low, word, "", ends
        else:
            out = _PLAIN, low, "", "", ends
        if len(self) < 300_000:
            self[raw] = out
        return out


def tokens(text: str | None, words: Words) -> tuple[list[str], list[str]]:
    """Canonical tokens and, for each, the value in its slot ('' where it is literal)."""
    out, values = [], []
    start, after_number = True, False
    for raw in (text or "").split():
        kind, low, value, unit, ends = words[raw]
        if kind == _NOTHING:
            start = start or ends
            continue
        if kind in (_NUM, _NUM_UNIT):
            out.append(NUMBER)
            values.append(value)
            if kind == _NUM_UNIT:
                out.append(UNIT)
                values.append(unit)
        elif kind == _CAPITAL and not start or kind == _UNIT and after_number:
            out.append(NAME if kind == _CAPITAL else UNIT)
            values.append(value)
        else:
            out.append(low)
            values.append("")
        after_number, start = kind == _NUM, ends
    return out, values


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode())


class Hashes(dict):
    """Number of each word met, a place in arrays of its kind, hash and end; starts anew when full, between texts."""

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.words, self.most = Words(), most
        self.kind, self.hash, self.ends = np.zeros(1024, np.int8), np.zeros(1024, _U), np.zeros(1024, bool)

    def __missing__(self, raw: str) -> int:
        at = self[raw] = len(self)
        if at >= len(self.kind):
            self.kind, self.hash, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.hash, self.ends))
        self.kind[at], low, _, _, self.ends[at] = Words.__missing__(_FORGET, raw)
        self.hash[at] = token_hash(low)
        return at

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """What tokens() gives, as the tokens' hashes and whether they are literal."""
        if len(self) > self.most:
            self.clear()
        raw = text.split()
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        kind, ends = self.kind[at], self.ends[at]
        if (void := kind == _NOTHING).any():
            for i in np.flatnonzero(void)[::-1].tolist():
                if i and ends[i]:
                    ends[i - 1] = True
            at, kind, ends = at[~void], kind[~void], ends[~void]
        start = np.append(True, ends[:-1])[: len(at)]
        name = (kind == _CAPITAL) & ~start
        number = (kind == _NUM) | (kind == _NUM_UNIT)
        unit = (kind == _UNIT) & np.append(False, kind[:-1] == _NUM)[: len(at)]
        h = self.hash[at]
        h[name], h[number], h[unit] = _NAME_HASH, _NUMBER_HASH, _UNIT_HASH
        literal = ~(name | number | unit)
        if (glued := kind == _NUM_UNIT).any():
            times = 1 + glued
            second = np.cumsum(times)[glued] - 1
            h, literal = np.repeat(h, times), np.repeat(literal, times)
            h[second] = _UNIT_HASH
        return h, literal


_NUMBER_HASH, _UNIT_HASH, _NAME_HASH = (_U(token_hash(t)) for t in (NUMBER, UNIT, NAME))


def windows(h: np.ndarray, literal: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Hash of each window of a width, by its first place; 0 where too few of its tokens are literal."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    out = h[: n - width + 1] + _U(width)
    for j in range(1, width):
        out = (out ^ (out >> _U(32))) * _U(0x9E3779B97F4A7C15) + h[j : n - width + 1 + j]
    out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9) | _U(1)
    if not literal.all():
        sums = np.cumsum(np.append(0, literal))
        out[sums[width:] - sums[: n - width + 1] < min(LITERAL, width)] = 0
    return out


def lines_of(text: str, hashes: Hashes, widths: set[int]) -> np.ndarray:
    """Hashes of the text's lines that have so few tokens."""
    out = []
    for line in {*text.split("\n"), text}:
        found = hashes.tokens(line)
        if len(found[0]) in widths:
            out += windows(*found, len(found[0])).tolist()
    return np.array(out, _U)


def consistent(places: list[int], shift: int, item_values: list[str], doc_values: list[str]) -> list[int]:
    """Of the item places whose windows match at place + shift, those whose slots agree with one another."""
    there: dict[tuple[str, bool], str] = {}
    out = []
    for p in places:
        new, ok = {}, True
        for k in range(p, min(p + WINDOW, len(item_values))):
            a, b = item_values[k], doc_values[k + shift]
            if a:
                for key, value in (((a, True), b), ((b, False), a)):
                    if new.get(key, there.get(key, value)) != value:
                        ok = False
                    new[key] = value
        if ok:
            there |= new
            out.append(p)
    return out


def coverage(hits: list[tuple[int, int]], item_values: list[str], doc_values: list[str], total: int) -> float:
    """Largest share of an item's windows found in one stretch of the document of about twice its length; hits: (place in
    document, in item). Of a stretch's alignments the longest come first; a place that one has taken is taken."""
    by_shift: dict[int, list[int]] = defaultdict(list)
    for d, p in hits:
        by_shift[d - p].append(p)
    runs = []
    for shift, places in by_shift.items():
        if ok := consistent(sorted(places), shift, item_values, doc_values):
            runs.append((ok[0] + shift, -len(ok), shift, ok))
    runs.sort(key=lambda r: r[:3])
    best, length = 0.0, len(item_values)
    for i, (start, size, _, _) in enumerate(runs):
        if -size == total:
            return 1.0
        near = []
        for run in runs[i:]:
            if run[0] > start + 2 * length:
                break
            near.append(run)
        if -sum(r[1] for r in near) / total <= best:
            continue
        used_d: set[int] = set()
        used_p: set[int] = set()
        for _, _, shift, places in sorted(near, key=lambda r: (r[1], r[0], r[2])):
            free = [p for p in places if p not in used_p and p + shift not in used_d]
            used_p.update(free)
            used_d.update(p + shift for p in free)
        best = max(best, len(used_p) / total)
    return best


class Items:
    """The items' tokens and an index of their windows, by width."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes, self.ids, self.values, self.total, self.lines = Hashes(), [], [], [], {}
        held: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in rows:
            values = tokens(text, hashes.words)[1]
            width = min(WINDOW, len(values))
            w = windows(*hashes.tokens(text), width) if width else ()
            real = np.flatnonzero(w)
            if not len(real):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.values.append(values)
            self.total.append(len(real))
            if width < WINDOW:
                self.lines.setdefault(int(w[0]), []).append(k)
            if width < LITERAL:
                continue
            for p in real.tolist():
                held.setdefault(width, {}).setdefault(int(w[p]), []).append((k, p))
        self.short = {len(self.values[k]) for ks in self.lines.values() for k in ks}
        #: width to sorted hashes and their postings
        self.index = {width: (keys := np.array(sorted(by), _U), [by[int(h)] for h in keys]) for width, by in held.items()}

    def search(self, text: str | None, hashes: Hashes) -> dict[int, float]:
        """Item index to coverage, for items that may reach SHARE; those with less are left out as a rule."""
        if not text or not self.ids:
            return {}
        out: dict[int, float] = {}
        found = hashes.tokens(text)
        values = None
        for width, (keys, postings) in self.index.items():
            w = windows(*found, width)
            if not len(w):
                continue
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for d in np.flatnonzero(keys[at] == w).tolist():
                for k, p in postings[at[d]]:
                    hits[k].append((d, p))
            for k, h in hits.items():
                need = SHARE * self.total[k]
                if len({p for _, p in h}) >= need and len({d for d, _ in h}) >= need:
                    values = values or tokens(text, hashes.words)[1]
                    out[k] = coverage(h, self.values[k], values, self.total[k])
        if self.short:
            for h in lines_of(text, hashes, self.short).tolist():
                out |= dict.fromkeys(self.lines.get(h, ()), 1.0)
        return out


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row: doc_id, contaminated, kept (not contaminated), n_items, item_ids (sorted, comma-joined), coverage."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    real = item_rows(items, item_id, item_text)
    index = item_index(real, broadcast_windows)
    if index is None:
        hits = joined(rows, real).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item_id")).alias("found"), F.max("cover").alias("cover"))
        t1, t2 = text_key("text")
        out = rows.join(hits, (t1 == F.col("t1")) & (t2 == F.col("t2")), "left")
        n = F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))
        return out.select("doc_id", (n > 0).alias("contaminated"), (n == 0).alias("kept"), n.cast("bigint").alias("n_items"), F.coalesce(F.array_join(F.col("found").cast("array<string>"), ","), F.lit("")).alias("item_ids"), F.coalesce("cover", F.lit(0.0)).alias("coverage"))
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        hashes, index = Hashes(), held.value
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                out = []
                for text in texts:
                    got: dict[int, float] = {}
                    for k, c in index.search(text, hashes).items():
                        if c >= SHARE:
                            got[index.ids[k]] = max(c, got.get(index.ids[k], 0))
                    out.append(_row(got))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "contaminated": pa.array(cols[0]), "kept": pa.array(cols[1]), "n_items": pa.array(cols[2], pa.int64()), "item_ids": pa.array(cols[3]), "coverage": pa.array(cols[4], pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, contaminated boolean, kept boolean, n_items bigint, item_ids string, coverage double")


def _row(got: dict[int, float]) -> tuple:
    return bool(got), not got, len(got), ",".join(map(str, sorted(got))), max(got.values(), default=0.0)


def item_rows(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, text of the items, each different one once."""
    real = items.select(integer_id(items, item_id).alias("item_id"), F.col(item_text).alias("text"))
    return real.where("item_id is not null and text is not null").distinct()


def item_index(items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> Items | None:
    """The items' index if they are few enough for a broadcast, checked before anything is collected."""
    words, size = items.agg(F.sum(F.size(F.split("text", r"\s+"))), F.sum(F.octet_length("text"))).first()  # words bound the windows, but for glued units
    if (words or 0) > broadcast_windows or (size or 0) > BROADCAST_BYTES:
        return None
    return Items(sorted((r[0], r[1]) for r in items.collect()))


def text_key(column: str) -> tuple:
    """128 bits that stand for a text."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(t1, t2, item_id, cover) of the contaminated texts, for items of any number; rows: text; items: item_id, text.

    A hash join of windows finds the pairs that share windows of SHARE of an item's places, repeated ones counted as often
    as the item has them; each pair is verified from its texts. Equal texts are worked once."""
    keys = dict(zip(("t1", "t2"), text_key("text")))
    held = written(items.select(*(c.alias(f"i{k[1]}") for k, c in keys.items()), "item_id", F.col("text").alias("item")), "items")

    def item_windows(batches):
        hashes = Hashes()
        for batch in batches:
            for first, texts in pieces(batch, "item"):
                own = [batch.column(c).slice(first, len(texts)).to_pylist() for c in ("i1", "i2")]
                for i1, i2, text in zip(*own, texts):
                    found = hashes.tokens(text)
                    width = min(WINDOW, len(found[0]))
                    w = windows(*found, width) if width else np.zeros(0, _U)
                    h, n = np.unique(w[w != 0], return_counts=True)
                    m = len(h)
                    yield pa.RecordBatch.from_pydict({"i1": pa.array([i1] * m, pa.int64()), "i2": pa.array([i2] * m, pa.int64()), "width": pa.array([width] * m, pa.int32()), "h": pa.array(h.view(np.int64)), "times": pa.array(n, pa.int64()), "total": pa.array([int(n.sum())] * m, pa.int64())})

    wanted = written(mapped(held.select("i1", "i2", "item").dropDuplicates(["i1", "i2"]), item_windows, "i1 bigint, i2 bigint, width int, h bigint, times bigint, total bigint"), "windows")
    widths = {r.width for r in wanted.select("width").distinct().collect()}  # WINDOW at most
    long, short = {w for w in widths if w >= LITERAL}, {w for w in widths if w < WINDOW}
    texts = rows.where("text is not null").select(*(c.alias(k) for k, c in keys.items()), "text")

    def doc_windows(batches):
        hashes = Hashes()
        for batch in batches:
            for first, part in pieces(batch, "text"):
                own = [batch.column(c).slice(first, len(part)).to_pylist() for c in ("t1", "t2")]
                for t1, t2, text in zip(*own, part):
                    found = hashes.tokens(text)
                    w = np.unique(np.concatenate([np.zeros(0, _U), *(windows(*found, n) for n in long), *([lines_of(text, hashes, short)] if short else [])]))
                    w = w[w != 0]
                    m = len(w)
                    yield pa.RecordBatch.from_pydict({"t1": pa.array([t1] * m, pa.int64()), "t2": pa.array([t2] * m, pa.int64()), "h": pa.array(w.view(np.int64))})

    met = mapped(texts, doc_windows, "t1 bigint, t2 bigint, h bigint").join(wanted.select("h", "i1", "i2", "times", "total"), "h")
    # a text that stands in several rows gives each of its windows as often
    share = met.groupBy("t1", "t2", "i1", "i2", "h").agg(F.first("times").alias("times"), F.first("total").alias("total")).groupBy("t1", "t2", "i1", "i2").agg(F.sum("times").alias("n"), F.first("total").alias("total"))
    likely = share.where(F.col("n") >= SHARE * F.col("total")).select("t1", "t2", "i1", "i2")
    pairs = likely.join(held, ["i1", "i2"]).join(texts.dropDuplicates(["t1", "t2"]), ["t1", "t2"])

    def verify(batches):
        hashes = Hashes()
        for batch in batches:
            cover = [max(Items([(0, item)]).search(text, hashes).values(), default=0.0) for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())]
            out = batch.select(["t1", "t2", "item_id"]).append_column("cover", pa.array(cover, pa.float64()))
            yield out.filter(pa.array([c >= SHARE for c in cover], pa.bool_()))

    return mapped(pairs.select("t1", "t2", "item_id", "item", "text"), verify, "t1 bigint, t2 bigint, item_id bigint, cover double")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    real = item_rows(items)
    index = item_index(real, broadcast_windows)
    if index is None:
        t1, t2 = text_key(text_col)
        hit = joined(docs.select(F.col(text_col).alias("text")), real).select("t1", "t2").distinct()
        return docs.join(hit, (t1 == hit.t1) & (t2 == hit.t2), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        hashes, index = Hashes(), held.value
        for batch in batches:
            keep = [max(index.search(t, hashes).values(), default=0.0) < SHARE for _, texts in pieces(batch, text_col) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
