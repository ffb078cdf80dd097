"""Quality rules: every column against plain definitions, base columns as SQL, and what gibberish and scripts get."""

import math
import random
import statistics
import unicodedata

import duckdb
import pytest

from tessera.llm import quality as Q

LONG = {"en": "house river morning letter window garden", "de": "Haus Fluss Morgen Brief Fenster Garten", "fr": "maison rivière matin lettre fenêtre jardin"}


def prose(r, lang, n, share=0.4):
    common = Q.COMMON[lang].split()
    return " ".join(r.choice(common) if r.random() < share else r.choice(LONG[lang].split())[:-1] + r.choice("aeioust") + r.choice(["", "", ",", ".\n"]) for _ in range(n))


def gibberish(r, n):
    return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 9))) for _ in range(n))


def corpus():
    r = random.Random(21)
    rows = [(i, prose(r, lang := r.choice(list(LONG)), r.choice([55, 80, 130, 230, 300, 500])), lang) for i in range(420)]
    rows += [(500 + i, gibberish(r, n), "en") for i, n in enumerate((60, 120, 500, 3000))]
    rows += [(510, "".join(chr(r.randint(0x430, 0x44F)) if r.random() < 0.85 else " " for _ in range(1500)), "en")]
    rows += [(511, prose(r, "en", 200), "de"), (512, "".join(r.choice("%#&$") + w for w in prose(r, "en", 200).split()).replace("%", "% "), "en")]
    rows += [(520, gibberish(r, 90), "pl"), (521, prose(r, "de", 90), None), (522, prose(r, "en", 40_000), "en")]
    rows += [(530, None, "en"), (531, "", "de"), (532, "one two three " * 60, "en"), (533, "a\n\nb\na\n \na", "fr"), (533, "a\n\nb\na\n \na", "fr"), (None, prose(r, "fr", 90), "fr")]
    return rows


def char_class(c):
    kind, latin = unicodedata.category(c), "LATIN" in unicodedata.name(c, "")
    if c in "\t\n\x0b\x0c\r":
        return "line"
    for name, members in (("stop", ".,;:!?"), ("punctuation", "'\"()-[]")):
        if c in members:
            return name
    if kind[0] in "LM":
        return ("upper" if kind == "Lu" else "lower") if latin else "letter"
    return {"N": "digit", "Z": "space", "P": "symbol", "S": "symbol"}.get(kind[0], "other")


def shares(items, keys):
    n = max(1, len(items))
    return [items.count(k) / n for k in keys]


def distance(p, q):
    total = 0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(0, total))


def repeats(words):
    windows = list(zip(words, words[1:], words[2:]))
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    return len({k for i, w in enumerate(windows) if w in twice for k in range(i, i + 3)})


def by_definition(rows):
    """Row number to (ref_lang, distances, share, kept)."""
    vocabulary = sorted({w for x in Q.COMMON.values() for w in x.split()})
    told, hist = {}, {}
    for k, (_, text, lang) in enumerate(rows):
        words = (text or "").encode().split()
        failed = len(words) < 50 or 100 * repeats(words) > 50 * len(words)
        told[k] = None, None, None, None, not failed
        if text and lang in Q.COMMON and len(words) >= Q.MIN_WORDS and len(text) >= Q.MIN_CHARS:
            found = [w.strip(b".,;:!?\"'()[]").lower().decode() for w in words]
            common = [w for w in found if w in set(vocabulary)]
            hist[k] = lang, len(words), shares([char_class(c) for c in text], Q.CLASSES), [common.count(w) for w in vocabulary], failed
    refs = {}
    for lang in sorted(Q.COMMON):
        own = [h for h in hist.values() if h[0] == lang and not h[4]]
        if len(own) >= Q.MIN_DOCS:
            chars = [sum(h[2][i] for h in own) for i in range(len(Q.CLASSES))]
            words = [sum(h[3][i] / h[1] for h in own) for i in range(len(vocabulary))]
            refs[lang] = [c / sum(chars) for c in chars], [w / sum(words) for w in words]
    stats = {}
    for k, (lang, n, chars, words, failed) in hist.items():
        if lang in refs:
            total = sum(words)
            near = min((distance([w / total for w in words], r[1]), x) for x, r in refs.items()) if total >= Q.MIN_COMMON else (None, lang)
            stats[k] = near[1], min(5, int(math.log2(n // 50))), distance(chars, refs[near[1]][0]), near[0], total / n
    limits = {}
    for key in {s[:2] for s in stats.values()}:
        own = [stats[k][2:] for k in stats if stats[k][:2] == key and not hist[k][4]]
        if len(own) >= Q.MIN_DOCS:
            found = []
            for i, side in ((0, 1), (1, 1), (2, -1)):
                values = [round(s[i] * Q.BINS) / Q.BINS for s in own if s[i] is not None]
                middle = statistics.median_low(values)
                found.append(middle + side * Q.SPREADS * max(Q.LEAST[i], 1.4826 * statistics.median_low([abs(v - middle) for v in values])))
            limits[key] = found
    for k, (lang, size, char, word, share) in stats.items():
        held = next((limits[lang, z] for z in range(size, -1, -1) if (lang, z) in limits), None)
        if held:
            ok = char <= held[0] and (word is None or word <= held[1]) and share >= held[2]
            told[k] = lang, char, word, share, ok and not hist[k][4]
    return told


BASE_SQL = r"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
threes AS (SELECT k, i, w[i:i + 2] AS three FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) < 5000)),
twice AS (SELECT k, unnest([i, i + 1, i + 2]) AS place FROM (SELECT k, i, count(*) OVER (PARTITION BY k, three) AS n FROM threes) WHERE n > 1),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
found AS (SELECT k, doc_id, len(w) AS n_words, list_sum([length(x) FOR x IN w]) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
  (SELECT count(DISTINCT place) FROM twice WHERE twice.k = t.k) AS n_repeat_words FROM t LEFT JOIN lines USING (k))
SELECT doc_id, n_words, CAST(coalesce(word_chars, 0) AS BIGINT), n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words FROM found"""


def test_every_column(spark):
    rows = corpus()
    df = spark.createDataFrame([(*row, "x", 0.5) for row in rows], "doc_id bigint, text string, lang string, kept string, word_distance double").repartition(5)
    got = {}
    for r in Q.assess(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = by_definition(rows)
    for k, (i, _, _) in enumerate(rows):
        r, (lang, char, word, share, kept) = got[i][0], want[k]
        assert (r.ref_lang, r.kept) == (lang, kept), (i, r, want[k])
        for a, b in ((r.char_distance, char), (r.word_distance, word), (r.common_share, share)):
            assert a == b is None or abs(a - b) < 1e-4
    kept = {i: rs[0].kept for i, rs in got.items()}
    assert all(kept[i] for i in range(420)) and kept[511] and kept[522] and kept[520] and kept[521]
    assert not any(kept[i] for i in (500, 501, 502, 503, 510, 512))
    assert got[520][0].ref_lang is None and got[510][0].char_distance > 0.5
    assert sorted(str(x.doc_id) for x in Q.keep_good(df).collect()) == sorted(str(i) for i, rs in got.items() for r in rs if r.kept)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [x[:2] for x in rows if x[0] != 522])
    sql = sorted(con.execute(BASE_SQL).fetchall(), key=repr)
    assert sql == sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for rs in got.values() for r in rs if r.doc_id != 522), key=repr)


def test_too_few_documents_are_no_reference(spark):
    r = random.Random(2)
    rows = [(i, prose(r, "en", 120), "en") for i in range(Q.MIN_DOCS - 2)] + [(100, gibberish(r, 100), "en")]
    got = Q.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert all(x.kept and x.ref_lang is None for x in got)


@pytest.mark.parametrize("p,q,want", [([1.0, 0], [0, 1.0], 1), ([0.5, 0.5], [0.5, 0.5], 0)])
def test_js_distance(p, q, want):
    import numpy as np

    assert abs(float(Q.js_distances(np.array([p]), np.array([q]))[0, 0]) - want) < 1e-9
