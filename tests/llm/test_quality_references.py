import random

from tessera.llm import quality
from tests.llm.test_scans import frame, prose


def test_languages_without_a_reference_are_kept(spark):
    r = random.Random(4)
    rows = [(k, prose(r, "en", 120), "en") for k in range(60)] + [(100 + k, prose(r, "de", 120), "de") for k in range(19)]
    polish = "i w na z się nie do to jest że o jak ale po co tak za od przez dla".split()
    rows += [(200 + k, " ".join(r.choice(polish) if r.random() < 0.6 else "".join(r.choice("aącęłośz") for _ in range(6)) for _ in range(120)), "pl") for k in range(30)]
    rows += [(300, prose(r, "de", 120), None), (301, "wort " * 100, "de"), (302, " ".join("#%" + str(k) for k in range(200)), "en")]
    df = frame(spark, rows)
    got = {x.doc_id: x for x in quality.assess(df).collect()}
    assert {k for k, x in got.items() if not x.kept} == {301, 302}
    assert all((x.ref_lang, x.char_distance, x.word_distance) == (None, None, None) for k, x in got.items() if 100 <= k < 302)
    assert all(got[k].ref_lang == "en" for k in range(60))
    assert {x.doc_id for x in quality.keep_good(df).collect()} == set(got) - {301, 302}
