"""Byte-pair model of a SentencePiece file: tables, the prefix-table encoder and its parts.

Encoding keeps, for each prefix of a segment, the one last token of that prefix's encoding. A token ending at position i
is that token exactly when it and the last token of the prefix before it are a compatible pair, that is, when their
joined text encodes to these two tokens. Candidates come from an automaton over all pieces; ids are read off backwards.

Runs of blanks are the one place where pieces tie in score; they are merged after everything else and from the left, so
a run becomes its longest run pieces from the left.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    """Tables of a BPE SentencePiece model with byte fallback and no normalization."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.eos = p.eos_id()
        self.byte_id = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(p.is_byte(i) for i in self.byte_id) or any(p.is_unused(i) for i in range(n)):
            raise ValueError("needs a model with byte fallback and without unused pieces")
        self.ids = {p.id_to_piece(i): i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.text = {i: t for t, i in self.ids.items()}
        self.blank = self.ids[SPACE]
        self.runs = {len(t): i for t, i in self.ids.items() if not t.strip(SPACE)}
        words = [t for t in self.ids if len(t) > 1 and t.strip(SPACE)]
        order = sorted(words, key=lambda t: -p.get_score(self.ids[t]))
        scores = [p.get_score(self.ids[t]) for t in order]
        tail = [p.get_score(i) for k, i in self.runs.items() if k > 1]
        if len(set(scores)) < len(scores) or any(SPACE in t[1:] for t in words) or tail and max(tail) >= min(scores, default=0):
            raise ValueError("scores of word pieces must differ, and blanks stand only before words or alone")
        self._short_runs = [self._run_merged(k) for k in range(max(self.runs) + 1)]
        if len(self._short_runs[-1]) > 1:
            raise ValueError("the longest run of blanks must encode to itself")
        if any(c not in self.ids for t in words for c in t):
            raise ValueError("every character of a piece must be a piece")
        #: Rank of each word piece, 0 merges first.
        self.rank = {t: r for r, t in enumerate(order)}
        self._compatible: dict[tuple[str, str], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for t in self.ids:
            if (len(t) == 1 or t in self.rank) and self.merged(t) == [t]:
                self._automaton.add_word(t, t)
        self._automaton.make_automaton()
        probe = "a  b\n\tc \x00   ▁x<s></s> 12 345中\U0001f600      e"
        if self.encode_units(self.units(probe)) != p.encode(probe):
            raise ValueError("this model normalizes or segments in a way that isn't supported")

    def merged(self, text: str) -> list[str]:
        """Plain merges of a short text without blank runs, by definition: best rank first, leftmost first."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _run_merged(self, n: int) -> list[int]:
        """Ids of n blanks: all merges tie, so the leftmost goes first."""
        runs = [1] * n
        while at := next((i for i in range(1, len(runs)) if runs[i - 1] + runs[i] in self.runs), 0):
            runs[at - 1 : at + 1] = [runs[at - 1] + runs[at]]
        return [self.runs[k] for k in runs]

    def run(self, n: int) -> list[int]:
        most = len(self._short_runs) - 1  # the longest run merges with nothing, so what follows it stands alone
        return self._short_runs[most] * (n // most) + self._short_runs[n % most]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self._compatible.get(key)) is None:
            if len(self._compatible) >= 1_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self.merged(left + right) == [left, right]
        return known

    def segment(self, text: str) -> list[int]:
        """Ids of a text without blank runs."""
        if text in self.rank and self._automaton.exists(text):
            return [self.ids[text]]
        n, ids, start = len(text), [], 0
        last: list[str | None] = [None] * (n + 1)
        covered = 0
        compatible = self.compatible

        def close(end: int) -> None:
            """Ids of text[start:end], backwards from its end."""
            back, at = [], end
            while at > start:
                token = last[at]
                back.append(self.ids[token])
                at -= len(token)
            ids.extend(reversed(back))

        def unknown(until: int) -> None:
            nonlocal start, covered
            while covered < until:  # no piece ends here: bytes, and a new segment behind them
                close(covered)
                ids.extend(self.byte_id[b] for b in text[covered].encode())
                covered += 1
                start = covered

        for end, token in self._automaton.iter(text):
            end += 1
            if end > covered + 1:
                unknown(end - 1)
            if last[end] is not None:
                continue
            before = end - len(token)
            if before < start:
                continue
            if before == start or compatible(last[before], token):
                last[end] = token
                covered = end
        unknown(n)
        close(n)
        return ids

    def unit(self, key: str) -> list[int]:
        """Ids of one blank and `key`; key may begin with more blanks."""
        word = key.lstrip(SPACE)
        run = len(key) - len(word) + 1
        if run == 1:
            return self.segment(SPACE + word)
        ids = self.segment(SPACE + word) if word else [self.blank]
        run -= 1
        if ids[0] == self.blank:
            run += 1
            ids = ids[1:]
        return self.run(run) + ids

    @staticmethod
    def units(text: str) -> list[str]:
        """Parts of a text that no piece crosses: a run of blanks and a word, without the first blank of the run."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if SPACE + SPACE in text or text[0] == SPACE or text[-1] == SPACE:
            return [u[1:] for u in _UNITS.findall(SPACE + text)]
        return text.split(SPACE)

    def encode_units(self, units: list[str]) -> list[int]:
        return [i for u in units for i in self.unit(u)]


@lru_cache(4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class UnitMemo(dict):
    """Ids of units met before; stops admitting when full. Only a memo: it never changes a result."""

    def __init__(self, model: PieceModel, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = tuple(self.model.unit(key))
        if len(self) < self.most and len(key) <= 64:
            self[key] = ids
        return ids


def hexdigest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
