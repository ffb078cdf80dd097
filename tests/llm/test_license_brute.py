"""Licence scan against plain definitions: labels over every start, base columns as SQL."""

import math
import random
import re

import duckdb

from tessera.llm import licenses as L

FILLER = "the of and code file returns value when list is empty for each node in tree this a to".split()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stands(phrase, inside):
    return any(inside[i : i + len(phrase)] == phrase for i in range(len(inside) - len(phrase) + 1))


def labels_by_definition(text, rarity):
    """Label to best share, each template at each start."""
    ws, out = words(text), {}
    for label, notice, phrases in L.TEMPLATES:
        t, keys = words(notice), [words(p) for p in phrases]
        if not all(stands(k, ws) for k in keys):
            continue
        own = {w for k in keys for w in k}
        rare = sorted({w for w in ws if w in t and w not in own}, key=lambda w: (-rarity[w], w.encode()))[: L.RAREST]
        asked = own | set(rare)
        for start in range(-len(t), len(ws)):
            agree = {w for p, w in enumerate(t) if w in asked and 0 <= start + p < len(ws) and ws[start + p] == w}
            if len(agree) < min(2, len(set(t) & asked)):
                continue
            window = ws[max(0, start - L.SLACK) : max(0, start + len(t) + L.SLACK)]
            if all(stands(k, window) for k in keys):
                share = sum(min(t.count(w), window.count(w)) for w in set(t)) / len(t)
                if share >= L.MIN_SHARE:
                    out[label] = max(share, out.get(label, 0))
    return out


def corpus():
    r = random.Random(12)
    filler = lambda n: " ".join(r.choice(FILLER) for _ in range(n))
    texts = [None, "", " \n", "CC-BY cc by CC  BY;cc by", "mit license " * 400, "Straße über MIT License, naïve", "gnu general public\nlicense"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 3)):
            notice = r.choice(L.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 3, len(notice) // 4, len(notice) // 2])):
                at = r.randrange(len(notice))
                notice[at : at + 1] = r.choice([[], ["new"], [notice[at], "more"]])
                notice = notice or ["x"]
            parts += [filler(r.randint(0, 20)), " ".join(notice)]
        texts.append(" ".join([*parts, filler(r.randint(0, 30))]))
    texts.append(filler(50_000) + " " + L.TEMPLATES[1][1] + " " + filler(50_000))  # a very long text
    return list(enumerate(texts))


def test_every_label_and_base_column(spark):
    rows = corpus() + [(3, "a repeated id, CC BY"), (None, "Apache License")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, labels string")
    frequency = {w: sum(w in set(words(t)) for _, t in rows) for _, notice, _ in L.TEMPLATES for w in words(notice)}
    rarity = {w: math.log((1 + len(rows)) / (1 + n)) for w, n in frequency.items()}
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels): r for r in L.scan(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(BASE_SQL).fetchall()
    assert set(got) == set(want) and len(want) == len(rows)
    for i, text in rows[:-3]:  # all but the very long one and those after it
        found = labels_by_definition(text, rarity)
        r = next(r for r in got.values() if r.doc_id == i and (i != 3 or r.n_words > 5))
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | set(found))), text
        assert r.score == (1.0 if base else max(found.values(), default=0.0)), text
    long = next(r for r in got.values() if r.doc_id == len(corpus()) - 1)
    assert "apache-2.0" in long.labels.split(",") and long.n_words > 100_000
    assert sum(bool(r.labels) for r in got.values()) > 60


#: doc_id, n_words, n_base, first_word, last_word, base_labels
BASE_SQL = """WITH cut AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tokens AS (SELECT k, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS p FROM cut),
runs AS (SELECT k, p, a, lead(a) OVER t AS b, lead(a, 2) OVER t AS c, lead(a, 3) OVER t AS d FROM tokens WINDOW t AS (PARTITION BY k ORDER BY p)),
places AS (SELECT k, p, CASE WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'mit' AND b = 'license' THEN 'mit'
  WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND d = 'license' THEN 'gpl' END AS label FROM runs)
SELECT any_value(doc_id), any_value(len(w)), count(label), min(p), max(p), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
FROM cut LEFT JOIN (SELECT * FROM places WHERE label IS NOT NULL) USING (k) GROUP BY k"""


def test_two_notices_in_one_file_keep_both_labels():
    rarity = dict.fromkeys(L.index().postings, 1.0)
    alone = [set(L.method_labels(L.words_of(t), rarity)) for _, t, _ in L.TEMPLATES]
    assert all(label in found for (label, _, _), found in zip(L.TEMPLATES, alone))
    n = len(L.TEMPLATES)
    for a in range(n):
        for b in range(a + 1, n):
            both = L.method_labels(L.words_of(L.TEMPLATES[a][1] + "\n\n" + L.TEMPLATES[b][1]), rarity)
            assert alone[a] | alone[b] <= set(both), (a, b)
    every = L.method_labels(L.words_of("\n".join(t for _, t, _ in L.TEMPLATES)), rarity)
    assert set(every) == {t[0] for t in L.TEMPLATES}
