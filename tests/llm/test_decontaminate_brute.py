"""Decontamination: the table and the join against a plain search over all pairs of documents and items."""

import random

import pytest

from tessera.llm import decontaminate as D

WORDS = "river stone light la la ba seven house Tom Mary Anna walks eats apples 5 7 12 km 3kg the of and to $4 glass".split()


def windows_by_definition(text, width):
    found, values = D.tokens(text, D.Words())
    return [(p, tuple(found[p : p + width])) for p in range(len(found) - width + 1) if sum(not v for v in values[p : p + width]) >= min(D.LITERAL, width)], values


def cover_by_definition(item, text):
    """Share of the item's windows that the text covers."""
    n = len(D.tokens(item, D.Words())[0])
    width = min(D.WINDOW, n)
    own, values = windows_by_definition(item, width) if n else ([], [])
    if not own or not text:
        return 0.0
    if n < D.WINDOW:
        lines = [D.tokens(x, D.Words())[0] for x in [*text.split("\n"), text]]
        if D.tokens(item, D.Words())[0] in lines:
            return 1.0
        if n < D.LITERAL:
            return 0.0
    there, doc_values = windows_by_definition(text, width)
    hits = [(d, p) for d, a in there for p, b in own if a == b]
    best = 0.0
    by_shift = {}
    for d, p in hits:
        by_shift.setdefault(d - p, []).append(p)
    runs = [(shift, ok) for shift, ps in by_shift.items() if (ok := D.consistent(sorted(ps), shift, values, doc_values))]
    for start in {ok[0] + shift for shift, ok in runs}:
        taken_d, taken_p = set(), set()
        near = [(shift, ok) for shift, ok in runs if start <= ok[0] + shift <= start + 2 * n]
        for shift, ok in sorted(near, key=lambda r: (-len(r[1]), r[1][0] + r[0], r[0])):
            for p in [p for p in ok if p not in taken_p and p + shift not in taken_d]:
                taken_p.add(p)
                taken_d.add(p + shift)
        best = max(best, len(taken_p) / len(own))
    return best


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    items = [(i, text(r, r.choice([1, 2, 3, 4, 5, 6, 9, 14, 25]))) for i in range(70)]
    items += [(4, "an item id that has two texts for itself"), (200, "la " * 19), (201, "x" * 500 + " y" * 0), (202, "https://example.org/" + "a" * 450 + " " + "b" * 200 + " tail"), (203, ""), (204, None), (None, text(r, 9)), (205, "short one here")]
    rows = []
    for i in range(250):
        parts = [text(r, r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            item = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if item:
                    item[r.randrange(len(item))] = r.choice(WORDS)
            parts += [" ".join(item), text(r, r.randint(0, 8))]
        rows.append((i, r.choice(["\n", " "]).join(parts)))
    rows += [(900, "la la la la la"), (901, "la " * 40), (902, "noise words and short one here"), (903, "words\n" + "x" * 500 + "\nwords"), (904, items[-6][1] if items[-6][1] else ""), (905, None), (906, ""), (None, rows[3][1]), (7, rows[8][1]), (8, rows[8][1]), (907, text(r, 30_000) + " an item id that has two texts for itself " + text(r, 30_000))]
    return rows, items


def test_table_equals_join_equals_brute_force(spark, tables):
    rows, items = tables
    docs = spark.createDataFrame([(i, t, {"a": 1}, 5) for i, t in rows], "doc_id bigint, text string, t1 map<string,int>, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    real = [(i, t) for i, t in items if i is not None and t]
    want = []
    for i, t in rows[:-1]:
        covers = {}
        for k, item in real:
            covers[k] = max(covers.get(k, 0), cover_by_definition(item, t))
        hit = {k: c for k, c in covers.items() if c >= D.SHARE}
        want.append((i, bool(hit), not hit, len(hit), ",".join(map(str, sorted(hit))), max(hit.values(), default=0.0)))
    key = lambda x: tuple(map(repr, x))
    table = sorted((tuple(x) for x in D.find(docs, bench).collect()), key=key)
    join = sorted((tuple(x) for x in D.find(docs, bench, broadcast_windows=0).collect()), key=key)
    assert table == join
    assert sorted((x for x in table if x[0] != 907), key=key) == sorted(want, key=key)
    found = {x[0]: x[4].split(",") for x in table}
    assert found[900] == [""] and "200" in found[901] and "205" in found[902] and "201" in found[903] and "4" in found[907]
    assert 30 < sum(x[1] for x in table) < len(rows) - 30
    clean = sorted(str(x[0]) for x in table if x[2])
    for limit in (D.BROADCAST_WINDOWS, 0):
        kept = D.keep_clean(docs, bench, broadcast_windows=limit)
        assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == clean
        assert D.find(docs, bench.limit(0), broadcast_windows=limit).where("contaminated").count() == 0
        assert D.find(docs.limit(0), bench, broadcast_windows=limit).count() == 0
    with pytest.raises(TypeError):
        D.find(docs, spark.createDataFrame([("1", "a")], "item_id string, text string"))
