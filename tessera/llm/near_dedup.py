"""Near-duplicates by bottom-k sketches of one hash function.

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct word shingles, as 64-bit hashes, and
its sketch the SKETCH lowest of them, which it retains. Documents with the same set are one class; classes are compared.

1. Inverted lists of retained values. Values that only one class retains are dropped. Two sets that are similar enough
   share at least a number of retained values (exact for sets that fit their sketch; for larger ones half a sketch at
   t = 0.8, which a link at the very threshold misses with a chance under 1e-8), so each class is listed under the rarest
   of its values only, all but that many less one, and similar ones still meet. Lists are kept by bands of set size, as
   similar sets have similar sizes; of lists with the same classes one is kept.
2. A list of at most SMALL classes gives its pairs. A longer one gives each class with the list's leader only: the one
   with the fewest values of its own, which in a group of copies is what the others were made from. So candidates grow
   with the rows of the lists and not with their squares.
3. Every candidate pair, a leader's too, has its overlap of retained values counted, and the similarity estimated from the
   sketch of the union. It goes on only if the estimate leaves a link possible; a leader's pair already if it leaves a
   similarity of 2t - 1 possible (t = 0.8 for links).
4. Pairs that go on are verified by the exact Jaccard similarity of their full sets.
5. What leaders leave open: classes x and y of a list may be linked though y isn't linked to its leader l. If x is linked
   to l, y has a similarity of 2t - 1 to l at least, since 1 - similarity is a metric. So only classes go on that aren't
   linked to l, and those that are where a list holds such a y. They are listed under the rarest shingles of their full
   sets (exact). Lists that hang together by their classes are one group, whose classes are all compared with each other,
   since a pair shares many of its lists; where that is more pairs than the lists have, each list is compared by itself.
   A group is cut into blocks of about LATER classes or VALUES shingles, and each pair of blocks is a group of rows of its
   own, so that a task holds two blocks whatever the group's size; the sizes of all intersections come from products of
   their shingle tables, and two blocks give a spanning forest of their links. So this is done in one round. Its products
   grow with the square of what a group leaves open, its rows with that divided by LATER.

Links go through label propagation with pointer jumping, in tables; nothing about documents reaches the driver but the
numbers of rows left. Every table that is used again is written to the shared folder, and deleted once all that reads it
is written. What is aggregated by a key and joined back is written first, so that both sides of the join are plain
exchanges, which Spark splits where a key is hot.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; a row with a null
doc_id gets a null component and is kept, linked with nothing; rows that repeat get a result each; rows of one doc_id
with different texts go by their texts; other columns are ignored; an empty table gives an empty result; doc_ids must be
integers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

from ._common import bitmap, integer_id, mapped, may_hold, pieces, removed, written

SKETCH = 64
#: Most classes of a list that gives all its pairs, and about the classes and the shingles of a block of what leaders leave.
SMALL, LATER, VALUES = 8, 512, 400_000
_U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def shingle_sets(texts: list[str | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    h = np.fromiter((hashes[w] for words in split for w in words), _U, sum(map(len, split)))
    s = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        s = (s ^ (s >> _U(32))) * _U(0x9E3779B97F4A7C15) + h[j : j + len(s)]
    s = (s ^ (s >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    s ^= s >> _U(29)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= width:
            out.append(np.unique(s[at : at + n - width + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))] if n else [], _U))
        at += n
    return out


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t1, t2 (a hash of the text), n_shingles, sig (a hash of the whole set; null without shingles), sketch."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                sets = shingle_sets(texts, width, hashes)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: batch.column(c).slice(first, len(texts)) for c in ("doc_id", "t1", "t2")},
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "sig": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "sketch": pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    }
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    return mapped(rows, run, "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, sig binary, sketch array<bigint>")


def sketch_share(percent: int, links: int = 1) -> float:
    """Least share of a union's sketch that both retain, for sets that are linked over so many links: by chance a sketch
    has less than the similarity, but not by so much."""
    return max(0.0, 1 - links * (1 - percent / 100) - (0.3 if links == 1 else 0.35))


def by_rarest(values: DataFrame, sizes: DataFrame, least: str, percent: int) -> DataFrame:
    """Written lists (key, node, n, rare): each class under the rarest of its values, by band of size; rare: how many of them
    no other class has. values: node, v; sizes: node, n, and m, the number of its values; least: SQL for the number of
    values that a similar set shares, from n."""
    shared = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # a class's own values: those that others have too, rarest first; the ones that nobody has come before them
    held = values.join(shared, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    rows = held.join(sizes, "node")
    room = (F.size("held") - F.expr(least) + 1).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent * 1.001)))
    kept = rows.where(room > 0).select("node", "n", (F.col("m") - F.size("held")).alias("rare"), band.alias("band"), F.explode(F.slice("held", F.lit(1), room)).alias("x"))
    lists = written(kept.select("node", "n", "rare", F.explode(F.array(F.xxhash64("x.v", "band"), F.xxhash64("x.v", F.col("band") + 1))).alias("key")), "lists")
    removed(shared)
    return lists


def sketch_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Lists by retained values; classes: node, n, sketch."""
    least = f"if(n * 100 <= {SKETCH * percent}, (n * {percent} + 99) div 100, {max(1, round(SKETCH * sketch_share(percent)))})"
    return by_rarest(classes.select("node", F.explode("sketch").alias("v")), classes.select("node", "n", F.size("sketch").alias("m")), least, percent)


def full_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Lists by all shingles; sets: node, n, shingles."""
    return by_rarest(sets.select("node", F.explode("shingles").alias("v")), sets.select("node", "n", F.col("n").alias("m")), f"(n * {percent} + 99) div 100", percent)


def distinct_lists(lists: DataFrame) -> DataFrame:
    """Written lists (key, node, n, rare) of two or more; one of those that hold the same. lists is written, and goes."""
    row = F.xxhash64("node")
    marks = lists.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(row).alias("x"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("y")).where("c > 1")
    keys = written(marks.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "keys")
    found = written(lists.join(keys, "key"), "lists")
    removed(keys, lists)
    return found


def candidate_pairs(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written (a, b, leads): the pairs of short lists and those of leaders a (leads); and (a, b): what is in the lists that
    each leader leads. lists is written, and goes."""
    sizes = written(lists.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rare", "n", "node")).alias("lead")), "sizes")
    rows = written(lists.join(sizes, "key").select("key", "node", (F.col("size") <= SMALL).alias("short"), F.col("lead.node").alias("a")), "rows")
    short = rows.where("short").select("key", "node")
    pairs = short.join(short.select("key", F.col("node").alias("b")), "key").where("node < b").select(F.col("node").alias("a"), "b", F.lit(False).alias("leads"))
    led = written(rows.where("not short and a <> node").select("a", F.col("node").alias("b")).distinct(), "led")
    both = written(pairs.union(led.select("a", "b", F.lit(True))).groupBy("a", "b").agg(F.max("leads").alias("leads")), "pairs")
    removed(sizes, rows, lists)
    return both, led


def _padded(column: pa.Array) -> np.ndarray:
    """Sketches as rows of SKETCH values, filled up with the largest number, which stands for none."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), SKETCH), np.iinfo(_U).max, _U)
    out[np.arange(SKETCH) < sizes[:, None]] = column.flatten().to_numpy().view(_U)
    return out


def overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sketches: how many values both retain, and the similarity estimated from the sketch of the union."""
    both = np.sort(np.concatenate([_padded(a), _padded(b)], 1), 1)
    real = both != np.iinfo(_U).max
    again = np.zeros_like(real)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, 1)
    return again.sum(1), (again & (rank <= SKETCH)).sum(1) / np.clip(rank[:, -1], 1, SKETCH)


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b, leads, overlap, likely: whether a pair goes on to be verified. pairs: a, b, leads; sketches: node, sketch."""
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    rows = pairs.join(right, "b").join(left, "a")

    def run(batches):
        for batch in batches:
            overlap, share = overlaps(batch.column("sketch_a"), batch.column("sketch_b"))
            least = np.where(batch.column("leads").to_numpy(zero_copy_only=False), sketch_share(percent, 2), sketch_share(percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "leads")), pa.array(overlap), pa.array(share >= least)], names=["a", "b", "leads", "overlap", "likely"])

    return mapped(rows, run, "a bigint, b bigint, leads boolean, overlap bigint, likely boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, rid_a, rid_b, linked, close: that b isn't linked to a but may be to classes that are. pairs: a, b."""
    left = sets.select(F.col("node").alias("a"), F.col("rid").alias("rid_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("rid").alias("rid_b"), F.col("shingles").alias("set_b"))
    rows = pairs.join(right, "b").join(left, "a")

    def run(batches):
        for batch in batches:
            linked, close = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = x.values.to_numpy().view(_U), y.values.to_numpy().view(_U)
                n = int(np.isin(y, x, assume_unique=True).sum())
                union = len(x) + len(y) - n
                linked.append(100 * n >= percent * union)
                close.append(not linked[-1] and 100 * n >= (2 * percent - 100) * union)
            cols = {k: batch.column(k) for k in ("a", "b", "rid_a", "rid_b")}
            yield pa.RecordBatch.from_pydict(cols | {"linked": pa.array(linked, pa.bool_()), "close": pa.array(close, pa.bool_())})

    return mapped(rows, run, "a bigint, b bigint, rid_a bigint, rid_b bigint, linked boolean, close boolean")


def left_open(found: DataFrame, led: DataFrame) -> DataFrame:
    """Written node: the classes that the leaders leave open; found: of verified()."""
    rows = led.join(found.select("a", "b", "linked", "close"), ["a", "b"], "left")
    members = written(rows.select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("close", F.lit(False)).alias("close")), "members")
    has = members.groupBy("a").agg(F.sum((~F.col("linked")).cast("int")).alias("apart"), F.max("close").alias("any_close")).where("apart > 1 or any_close")
    has = written(has, "has")
    out = written(members.join(has, "a").where("not linked or any_close").select(F.col("b").alias("node")).distinct(), "open")
    removed(members, has)
    return out


def cells(lists: DataFrame) -> DataFrame:
    """Written (cell, node, n, parts): what is compared with each other: groups of lists that hang together, or the lists
    where these have fewer pairs; parts: into how many blocks a cell is cut. lists is written, and goes."""
    star = written(lists.groupBy("key").agg(F.min("node").alias("x"), F.count("*").alias("c")), "star")
    edges = written(lists.join(star, "key").where("node <> x").select("x", F.col("node").alias("y")).distinct(), "edges")
    labels = components(edges)
    sizes = labels.groupBy("label").agg(F.count("*").cast("double").alias("size"))
    apart = star.join(labels, star.x == labels.id).groupBy("label").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
    whole = written(sizes.join(apart, "label").select("label", (F.col("size") * F.col("size") <= F.col("pairs")).alias("whole")), "whole")
    groups = written(labels.join(whole, "label").select(F.col("id").alias("node"), "label", "whole"), "groups")
    members = lists.join(groups, "node").select(F.when(F.col("whole"), F.col("label")).otherwise(F.col("key")).alias("cell"), "node", "n")
    members = written(members.distinct(), "members")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(LATER), F.sum("n") / F.lit(VALUES)))
    cuts = written(members.groupBy("cell").agg(parts.cast("int").alias("parts")), "cuts")
    found = written(members.join(cuts, "cell"), "cells")
    removed(star, edges, labels, whole, groups, members, cuts, lists)
    return found


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: values that many sets have by products of tables of 0 and
    1, the others by the pairs of sets that have them."""
    values = np.concatenate([*a, *b])
    own = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)])
    at = sum(map(len, a))
    col = np.unique(values, return_inverse=True)[1]
    c = [np.bincount(part, minlength=col.max() + 1) for part in (col[:at], col[at:])]
    out = np.zeros((len(a), len(b)), np.int64)
    often = c[0] * c[1] * 200 > len(a) * len(b)
    sides = []
    for part, owner in ((col[:at], own[:at]), (col[at:], own[at:])):
        order = np.argsort(part, kind="stable")
        sides.append((part[order], owner[order]))

    def step(chosen: np.ndarray, weight: np.ndarray, most: int):
        """Entries (column, set) of both sides for slices of the chosen columns of about this weight."""
        cuts = np.searchsorted(np.cumsum(weight[chosen]), np.arange(0, weight[chosen].sum(), most))
        for first, last in zip(cuts, [*cuts[1:], len(chosen)]):
            if last > first:
                new = np.full(len(often), -1)
                new[chosen[first:last]] = np.arange(last - first)
                yield last - first, [(new[k[0]][hit], k[1][hit]) for k in sides for hit in [new[k[0]] >= 0]]

    for width, entries in step(np.flatnonzero(often), np.ones(len(often), np.int64), 4096):
        tables = [np.zeros((len(x), width), np.float32) for x in (a, b)]
        for made, (k, owner) in zip(tables, entries):
            made[owner, k] = 1
        out += (tables[0] @ tables[1].T).astype(np.int64)
    for width, ((ka, oa), (kb, ob)) in step(np.flatnonzero(~often & (c[0] > 0) & (c[1] > 0)), c[0] * c[1], 2_000_000):
        times = np.bincount(kb, minlength=width)
        first = np.cumsum(times) - times
        n = times[ka]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[ka], n)
        out += np.bincount(np.repeat(oa, n) * len(b) + ob[place], minlength=out.size).reshape(out.shape)
    return out


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n-1 that each of them reaches by the links (x, y)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, x, was[y])
        np.minimum.at(label, y, was[x])
        label = label[label]
        if (label == was).all():
            return label


def cell_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written links (x, y), a spanning forest of those of each two blocks of each cell; members: of cells()."""
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts"))
    rows = members.select("cell", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("other"))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own")
    rows = rows.join(sets.select("node", "rid", "shingles"), "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        side = table["own"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links = np.empty(0, np.int64), np.empty(0, np.int64)
        label = np.arange(len(side))
        if len(left) and len(right) and len(side) > 1:
            held = [s.values.to_numpy().view(_U) for s in table["shingles"]]
            n = np.array([len(s) for s in held])
            common = intersections([held[k] for k in left], [held[k] for k in right])
            x, y = np.nonzero(100 * common >= percent * (n[left][:, None] + n[right] - common))
            label = forest(left[x], right[y], len(side))
            links = np.flatnonzero(label != np.arange(len(side))), label[label != np.arange(len(side))]
        cols = {f"{c}_{k}": table[c].take(pa.array(at)) for k, at in zip("xy", links) for c in ("rid", "node")}
        return pa.Table.from_pydict(cols)

    ship(members.sparkSession)
    found = rows.groupBy("cell", "i", "j").applyInArrow(run, "rid_x bigint, node_x bigint, rid_y bigint, node_y bigint")
    x, y = (F.struct(F.col(f"rid_{k}").alias("rid"), F.col(f"node_{k}").alias("node")).alias(k) for k in "xy")
    return written(found.select(x, y).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """Written (id, label): the smallest id that each id of links (x, y) reaches."""
    edges = written(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.id).groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        after = written(labels.join(near, "id").join(jump, "label").select("id", F.col("label").alias("was"), F.least("label", "near", "jump").alias("label")), "labels")
        removed(labels)
        labels = after
        if after.where("was <> label").isEmpty():
            removed(edges)
            found = after.select("id", "label")
            found.tessera_path = after.tessera_path
            return found


def links_of(found: DataFrame) -> DataFrame:
    x, y = (F.struct(F.col(f"rid_{k}").alias("rid"), F.col(k).alias("node")) for k in "ab")
    return written(found.where("linked").select(x.alias("x"), y.alias("y")), "links")


def labelled(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Features of each row, and of each class (sig, own, label): its own id, a struct of its smallest doc_id and a hash, and
    the smallest one that it reaches. rows: doc_id, text."""
    feats = written(features(rows, width), "features")
    real = feats.where("sig is not null and doc_id is not null")
    classes = real.groupBy("sig").agg(F.min("doc_id").alias("rid"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.xxhash64("sig"))
    classes = written(classes, "classes")
    pairs, led = candidate_pairs(distinct_lists(sketch_lists(classes, percent)))
    weighed = written(estimated(pairs, classes.select("node", "sketch"), percent), "weighed")
    likely = weighed.where("likely")
    active = written(likely.select(F.col("a").alias("node")).union(likely.select("b")).union(led.select("a")).union(led.select("b")).distinct(), "active")
    wanted = written(classes.select("sig", "rid", "node").join(active, "node"), "wanted")
    sets = written(full_sets(rows, wanted, width), "sets")
    found = written(verified(likely.select("a", "b"), sets, percent), "verified")
    links = [links_of(found)]
    rest = left_open(found, led)
    removed(pairs, led, weighed, active, wanted, found)
    lists = distinct_lists(full_lists(sets.join(rest, "node", "left_semi"), percent))
    if lists.isEmpty():
        removed(lists)
    else:
        members = cells(lists)
        links.append(cell_links(members, sets, percent))
        removed(members)
    labels = components(reduce(DataFrame.union, links))
    removed(sets, rest, *links)
    own = classes.select("sig", F.struct("rid", "node").alias("own"))
    return feats, own.join(labels, own.own == labels.id, "left").select("sig", "own", F.coalesce("label", "own").alias("label"))


def group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Links are sets with 100 * |intersection| >= percent * |union|."""
    feats, classes = labelled(docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    grouped = feats.where("sig is not null and doc_id is not null").join(classes, "sig").select("doc_id", "n_shingles", F.col("label.rid").alias("component_id"))
    alone = feats.where("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are left when one document of each group stays: that of the smallest doc_id.

    A row is meant by its doc_id and text: of rows that repeat both one is left, and of a repeated doc_id with different
    texts each goes by its own text. Null doc_ids come last in a group, by a hash of the text. Texts without shingles stay
    in all their rows."""
    text = docs[text_col]
    late = F.lit(2**62) + F.shiftright(F.abs(F.shiftright(F.xxhash64(text), 1)), 1)
    key = F.coalesce(integer_id(docs, id_col), late)
    feats, classes = labelled(docs.select(key.alias("doc_id"), text.alias("text")), width, percent)
    best = classes.where("own = label").select("sig", F.col("own.rid").alias("rid"))
    rows = feats.where("sig is not null").join(best, "sig").where("doc_id = rid").select("doc_id", "t1", "t2").distinct()
    stays = written(rows, "stays")
    t1, t2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    of_group = docs.join(stays, (key == stays.doc_id) & (t1 == stays.t1) & (t2 == stays.t2), "left_semi")
    blank = F.coalesce(~F.rlike(text, F.lit(r"[^ \t-\r]")), F.lit(True))
    others = [c for c in docs.columns if c != text_col]
    order = F.xxhash64(F.to_json(F.struct(*(docs[c] for c in others)))) if others else F.lit(0)
    # aggregated where the rows are first, so that many equal ones make no large group
    one = of_group.where(~blank).groupBy(key.alias("k"), t1.alias("t1"), t2.alias("t2")).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), order).alias("row"))
    return one.select("row.*").unionByName(docs.where(blank))


def full_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, sig, rid, n, shingles) of the classes in wanted (node, sig, rid), made again from their texts. A bitmap of
    the wanted ids, of a fixed size, keeps most other texts from being worked again; the join decides."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("rid"))))
    texts = rows.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            chosen = batch.filter(pa.array([may_hold(bits.value, h) == 1 for h in batch.column("h").to_pylist()], pa.bool_()))
            for first, found in pieces(chosen, "text"):
                sets = shingle_sets(found, width, hashes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "sig": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        "rid": chosen.column("doc_id").slice(first, len(found)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    }
                )

    made = mapped(texts, run, "sig binary, rid bigint, n bigint, shingles array<bigint>").join(wanted.select("sig", "rid"), ["sig", "rid"])
    # one row a class, also where rows repeat
    return made.groupBy("sig", "rid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).withColumn("node", F.xxhash64("sig"))
