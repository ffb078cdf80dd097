import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import near_dedup
from tessera.llm.near_dedup import SMALL, group, keep_one, overlaps, sketch_share


def brute(rows, width, percent=80):
    """doc_id to (set size, smallest doc_id reached), from all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(spark, rows, width=4):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in group(df, width=width).collect()}


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edited(r, base, n):
    out = list(base)
    for _ in range(n):
        k = r.randrange(3)
        at = r.randrange(len(out))
        if k == 0:
            out[at] = words(r, 1)[0]
        elif k == 1:
            out.insert(at, words(r, 1)[0])
        elif len(out) > 1:
            del out[at]
    return out


@pytest.mark.parametrize("seed,length,small", [(1, 120, SMALL), (2, 40, 3)])
def test_groups_of_edited_copies(spark, monkeypatch, seed, length, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # few, so that leaders lead, and lead again
    monkeypatch.setattr(near_dedup, "LATER", 4 if small < SMALL else near_dedup.LATER)
    r = random.Random(seed)
    base = words(r, length)
    passage = " ".join(words(r, 30))
    texts = [" ".join(edited(r, base, r.randint(0, 7))) for _ in range(60)]  # copies of one text
    chain = base[:]
    for _ in range(40):  # each a copy of the one before
        chain = edited(r, chain, r.randint(1, 4))
        texts.append(" ".join(chain))
    texts += [" ".join(words(r, r.randint(1, 60))) + " " + passage for _ in range(40)]
    texts += [r.choice(texts) for _ in range(20)] + [r.choice(texts).upper() for _ in range(5)]
    texts += ["", " \n", None, "one two", "one  two", "One two three", "x " * 3000]
    r.shuffle(texts)
    rows = list(enumerate(texts, 7))
    assert len(texts) > SMALL
    assert run(spark, rows) == brute(rows, 4)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (2, "a b c d e f", 3), (4, None, 4)], "doc_id bigint, text string, sig int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in group(df).collect())
    assert got == [(0, 2, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True)]
    assert group(df.limit(0)).count() == 0


def test_overlaps_and_estimates():
    import numpy as np
    import pyarrow as pa

    r = random.Random(7)
    pairs = []
    for _ in range(300):
        pool = [r.getrandbits(64) for _ in range(r.randint(1, 140))]
        pairs.append(tuple(sorted(r.sample(pool, r.randint(1, len(pool))))[: near_dedup.SKETCH] for _ in "ab"))
    a, b = (pa.array([np.array(p[i], np.uint64).view(np.int64) for p in pairs], pa.list_(pa.int64())) for i in (0, 1))
    overlap, estimate = overlaps(a, b)
    for k, (x, y) in enumerate(pairs):
        union = sorted({*x, *y})[: near_dedup.SKETCH]
        assert overlap[k] == len({*x} & {*y}) and abs(estimate[k] - len({*x} & {*y} & {*union}) / len(union)) < 1e-12
    assert abs(sketch_share(80) - 0.5) < 1e-9 and abs(sketch_share(80, 2) - 0.25) < 1e-9 and sketch_share(20) == 0


def test_one_row_of_each_group_stays(spark):
    r = random.Random(3)
    base = words(r, 80)
    near = " ".join(edited(r, base, 1))
    rows = [(5, " ".join(base), "a", 1), (3, near, "b", 2), (3, near, "b", 2), (3, near, "c", 2), (3, "an altogether other text of the same id that is alone", "d", 3)]
    rows += [(None, " ".join(base), "e", 4), (None, "this text of no id stands twice in the table", "f", 5), (None, "this text of no id stands twice in the table", "g", 5)]
    rows += [(7, None, "h", 6), (7, "", "i", 6), (8, " \n", "j", 6), (9, "one", "k", 6), (10, "ONE", "l", 6), (3, "an altogether other text of the same id that is alone", "m", 3)]
    df = spark.createDataFrame([(*x, {"k": 1}) for x in rows], "doc_id bigint, text string, t1 string, rid int, m map<string,int>")
    got = keep_one(df)
    assert got.columns == df.columns and got.schema["m"].dataType == df.schema["m"].dataType
    found = Counter((str(x.doc_id), x.text) for x in got.collect())
    assert found == Counter([("3", near), ("3", rows[4][1]), ("None", rows[6][1]), ("7", None), ("7", ""), ("8", " \n"), ("9", "one")])
    assert keep_one(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        group(spark.createDataFrame([("1", "a")], "doc_id string, text string"))
