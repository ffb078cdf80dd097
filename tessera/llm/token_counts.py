"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts are cut into units that no piece crosses. The units of a batch that aren't known yet stand in one ragged array of
symbols; each round finds every sequence's lowest rank and merges that pair in all sequences at once: all its places
from the left where no later merge of that token can come before them, otherwise the leftmost alone. What is left over
when no pair has a rank is counted. Units met before come from a bounded memo.

In sequences of over 64 symbols the lowest rank of each stretch is merged, not of the whole sequence: a merge and all
that follows from it stay within one piece's length, so places further apart than REACH don't touch each other and
their order is free. Long texts of equal places next to each other, where this makes no headway, are left to the prefix
table of token_pieces, which is as exact.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null and repeated doc_ids pass through; other columns
are ignored; an empty table gives an empty result; a text without blanks is one unit, worked in linear memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import mapped, pieces
from .token_pieces import SPACE, PieceModel, piece_model

_NONE = np.iinfo(np.int64).max
#: Symbols between places that are merged independently; more than twice the longest piece.
REACH = 48
#: Rounds of stretch-wise merging before a long text goes to the prefix table.
ROUNDS = 600


def _least_before(rank: np.ndarray, n: int) -> np.ndarray:
    """For each place, the least of the n places before it."""
    out = np.append(_NONE, rank[:-1])
    have = 1
    while have < n:
        step = min(have, n - have)
        out[step:] = np.minimum(out[step:], out[:-step].copy())
        have += step
    return out


class Merger:
    def __init__(self, model: PieceModel):
        self.model = model
        self.size = v = model.processor.get_piece_size()
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in model.ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        known = {t: i for t, i in model.ids.items() if len(t) == 1 or t in model.rank}
        pairs, first, ends = [], {}, set()
        for t, r in model.rank.items():
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    pairs.append((a * v + b, r, known[t]))
                for part in (a, b):
                    if part is not None:
                        first[part] = min(first.get(part, r), r)
        pairs.sort()
        self.key, self.rank, self.into = (np.array(x, np.int64) for x in zip(*pairs))
        #: by rank: no better-ranked pair can hold the token that this rank makes
        self.safe = np.array([first.get(known[t], r + 1) > r for t, r in model.rank.items()])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts have no blank runs."""
        lens = np.array([len(t) for t in texts])
        long = np.flatnonzero(lens > 64)
        if not len(long):
            return self._counts(texts, False)
        out = np.zeros(len(texts), np.int64)
        short = np.flatnonzero(lens <= 64)
        if len(short):
            out[short] = self._counts([texts[i] for i in short], False)
        for i in long:
            out[i] = self._counts([texts[i]], True)[0]
        return out

    def _counts(self, texts: list[str], stretches: bool) -> np.ndarray:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lens = np.array([len(t) for t in texts], np.int64)
        seq = np.repeat(np.arange(len(texts)), lens)
        sym = self.char[points].astype(np.int64)
        bare = sym < 0
        extra = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.bincount(seq[bare], weights=extra[bare], minlength=len(texts)).astype(np.int64)
        # an unknown character parts its neighbours: give what follows it a sequence of its own
        part = seq * 1 + np.cumsum(bare)
        keep = ~bare
        owner, sym, seq = seq[keep], sym[keep], part[keep]
        rounds = 0
        while len(sym):
            rounds += 1
            if stretches and rounds > ROUNDS:
                return np.array([len(self.model.segment(t)) for t in texts])
            same = seq[1:] == seq[:-1]
            key = np.where(same, sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where(self.key[at] == key, self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(sym)))
            done = np.repeat(best == _NONE, length)
            out += np.bincount(owner[done], minlength=len(out))
            if stretches:
                before, after = _least_before(rank, REACH), _least_before(rank[::-1], REACH)[::-1]
                hit = (rank <= after) & (rank <= before) & ~done & (rank != _NONE)
            else:
                hit = (rank == np.repeat(best, length)) & ~done
            where = np.flatnonzero(hit)
            if not len(where):
                break
            # of places next to each other every second one; of unsafe ranks only the first of a sequence
            gap = np.append(True, (np.diff(where) > 1) | (seq[where[1:]] != seq[where[:-1]]))
            head = np.maximum.accumulate(np.where(gap, np.arange(len(where)), 0))
            first = before[where] > rank[where] if stretches else np.append(True, seq[where[1:]] != seq[where[:-1]])
            if stretches:  # a row of equal places is taken from its very start or not yet
                top = where[head]
                first &= (top == 0) | (rank[top - 1] != rank[top])
                safe = self.safe[rank[where]] & ((top == 0) | (rank[top - 1] != rank[top]))
            else:
                safe = self.safe[rank[where]]
            take = where[((np.arange(len(where)) - head) % 2 == 0) & (first | safe)]
            sym[take] = self.into[at[take]]
            keep = ~done
            keep[take + 1] = False
            sym, seq, owner = sym[keep], seq[keep], owner[keep]
        return out

    def units(self, keys: list[str]) -> np.ndarray:
        """Tokens of units as PieceModel.units gives them."""
        words = [k.lstrip(SPACE) for k in keys]
        out = self.counts([SPACE + w for w in words])
        for i, (k, w) in enumerate(zip(keys, words)):
            if len(k) > len(w):  # a longer run of blanks: its last one may belong to the word
                run = len(k) - len(w) + 1
                alone = self.model.segment(SPACE + w)[0] == self.model.blank
                out[i] += len(self.model.run(run - 1 + alone)) - alone
        return out


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(piece_model(path))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo_size: int = 600_000) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches):
        merge, memo = merger(model_path), {}
        split = merge.model.units
        for batch in batches:
            for first, texts in pieces(batch, "text", 2_000_000):
                split_up = [split(t) if t else [] for t in texts]
                new = list({u for units in split_up for u in units if u not in memo})
                known = memo
                if new:
                    found = dict(zip(new, merge.units(new).tolist()))
                    if len(memo) + len(new) <= memo_size:
                        memo.update(found)
                    else:
                        known = memo | found
                get = known.__getitem__
                n = [sum(map(get, units)) for units in split_up]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(texts)),
                        "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "over_limit": pa.array([x > limit for x in n]),
                    }
                )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return mapped(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, schema)
