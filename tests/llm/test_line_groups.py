import random

from tessera.llm import line_dedup as L


def texts(spark, rows):
    return {x.doc_id: x.text for x in L.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_a_leaf_of_two_templates(spark):
    one = "please read the {} terms of this page before you go on"
    two = "please read the long story about {} and its eight lost ships"
    alone = "please read the notes that someone left here in May last"
    rows = [(k, (one if k < 6 else two).format(f"new{'abcdefghijkl'[k]}")) for k in range(12)]
    rows.append((12, alone + " year"))
    got = texts(spark, rows)
    assert {k for k, t in got.items() if t} == {0, 6, 12}


def test_a_thousand_edited_copies(spark):
    r = random.Random(5)
    original = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for k in range(1000):
        copy = list(original)
        for at in r.sample(range(L.LEADING, 20), 2):
            copy[at] = "".join(r.choice("uvwxyz") for _ in range(8))
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(original[: L.LEADING] + ["".join(r.choice("uvwxyz") for _ in range(8)) for _ in range(17)])) for k in range(20)]
    got = texts(spark, rows)
    assert {k for k, t in got.items() if t} == {0, *range(1000, 1020)}


def test_pairs_of_split_leaves_against_brute_force(spark):
    r = random.Random(7)
    rows = [(k, " ".join(["the", "same", "start"] + [r.choice("ab") + "x" if r.random() < 0.8 else r.choice("cd") for _ in range(n)])) for k in range(150) for n in (r.choice((5, 9)),)]
    cut = {k: t.split() for k, t in rows}
    near = lambda a, b: len(a) == len(b) and sum(x == y for x, y in zip(a, b)) >= L.LITERAL * len(a)
    want = {k for k in cut if not any(j < k and near(cut[j], cut[k]) for j in cut)}
    assert {k for k, t in texts(spark, rows).items() if t} == want and len(want) > 5
