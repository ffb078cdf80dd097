import random

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def brute(rows):
    """(doc_id, text) to text less its dropped lines, with a leaf's lines met one by one."""
    leaves, cut = {}, []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if any(c.isdigit() for c in t) else t for t in line.split()]
            if len(tokens) >= L.MIN_TOKENS:
                leaf = (len(tokens), *tokens[: L.LEADING])
                cut.append((doc, n, leaf, tuple(tokens)))
                known = leaves.get(leaf, tokens)
                leaves[leaf] = [a if a == b else "<*>" for a, b in zip(known, tokens)]
    one = {k for k, t in leaves.items() if "<*>" in t and sum(x != "<*>" for x in t) >= L.LITERAL * len(t)}
    places = {}
    for doc, n, leaf, own in cut:
        places.setdefault(leaf if leaf in one else own, []).append((doc, n))
    gone = {p for found in places.values() if len({d for d, _ in found}) > 1 for p in sorted(found)[1:]}
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(3)) for _ in range(40)]
    stock = [" ".join(r.choice(words) for _ in range(r.randint(3, 20))) for _ in range(30)]
    rows = []
    for i in range(120):
        lines = [r.choice(stock) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(1, 15))) for _ in range(r.randint(0, 8))]
        lines += [f"error in module core at line {r.randint(1, 99)} of the file", "user " + r.choice(words) + " has signed in from the office today"][: r.randint(0, 2)]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "same words in this long line\n" * 3), (203, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit(1)).withColumn("drop", F.lit("x"))
    got = L.dedup(df)
    assert got.columns[:4] == ["doc_id", "text", "line", "drop"]
    want = brute(rows)
    found = {x.doc_id: x for x in got.collect()}
    assert {k: x.text for k, x in found.items()} == want
    assert found[202].text.count("same") == 3  # within one document only
    assert any(x.line_dedup_n_dropped for x in found.values())


def test_variable_fields_and_nulls(spark):
    rows = [(None, "the job number 17 ended with code 3 on host a"), (1, "the job number 18 ended with code 4 on host a"), (2, "quite another line that stands here alone"), (2, "quite another line that stands here alone")]
    got = L.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [x.text for x in got] == [rows[0][1], "", rows[2][1], rows[2][1]]
    assert L.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
