import pytest

from tessera.llm import licenses
from tests.llm.test_scans import frame


@pytest.mark.parametrize("label", ["mit-license", "isc", "apache-2.0"])
def test_all_notices_of_a_file_are_found(spark, label):
    long = max((t for name, t, _ in licenses.TEMPLATES if name == label), key=len)
    short = [(name, t) for name, t, _ in licenses.TEMPLATES if t != long]
    rows = [(k, f"{long}\n\nsome code\n\n{t}", "en") for k, (_, t) in enumerate(short)]
    rows += [(1000, "\n\nsome code\n\n".join(t for _, t, _ in licenses.TEMPLATES), "en")]
    rows += [(2000 + k, t, "en") for k in range(60) for t in ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.")]
    got = {x.doc_id: set(x.labels.split(",")) for x in licenses.scan(frame(spark, rows)).collect()}
    assert all({label, name} <= got[k] for k, (name, _) in enumerate(short))
    assert {name for name, _, _ in licenses.TEMPLATES} <= got[1000]
