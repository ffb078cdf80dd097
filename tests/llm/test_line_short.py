from tessera.llm import line_dedup as L


def test_short_lines_and_scripts_without_blanks(spark):
    passage = "这是一个没有空格的很长的段落它在许多文件里重复出现所以应该只留下一次"
    shared = ["All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", passage]
    rows = [(k, "\n".join([f"Chapter number {k} begins here", *shared, "the end", passage[:15] + str(k) + passage[15:]])) for k in range(3)]
    got = {x.doc_id: x.text.split("\n") for x in L.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1].split("\n")
    for k in (1, 2):  # lines that differ in a number stay, as do the shortest
        assert got[k] == [x for x in rows[k][1].split("\n") if x not in shared]
