import json
import sys

import pytest

from tessera.plans import spec


def test_memos_are_bounded_in_bytes(monkeypatch):
    """Wide keys of many ids took several times the memory of usual ones, by the same number of entries."""
    monkeypatch.setattr(spec, "MEMO_BYTES", 200_000, raising=False)
    memo = spec.Memo(lambda key: key.encode("utf-32-le"), 10_000)
    keys = [chr(0x20000 + i) * 60 for i in range(3000)]
    for key in keys:
        assert memo[key] == key.encode("utf-32-le")
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())
    assert 100_000 < held < 250_000
    assert memo[keys[-1]] == keys[-1].encode("utf-32-le") and keys[-1] not in memo
    memo.clear()
    assert memo[keys[-1]] and keys[-1] in memo


@pytest.mark.parametrize("room", [0, 3000])
def test_full_memos_change_no_ids(monkeypatch, room):
    from tessera.plans import queries

    from .texts import ALL

    text = queries.spec().text
    want = [spec.Runtime(json.loads(text)).encode(t) for t in ALL]
    monkeypatch.setattr(spec, "MEMO_BYTES", room, raising=False)
    run = spec.Runtime(json.loads(text))
    assert [run.encode(t) for t in ALL] == want
