"""WordPiece: a word to token ids, longest match first."""

from __future__ import annotations

from tessera.errors import UnsupportedTokenizerError


class WordPiece:
    def __init__(self, vocab: dict[str, int], unk: str = "[UNK]", prefix: str = "##", max_chars: int = 100):
        if unk not in vocab:
            raise ValueError(f"unk_token {unk!r} is not in the vocabulary")
        if any(not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < 1 << 31 for i in vocab.values()):
            raise ValueError("token ids must be integers from 0 below 2^31")
        self.vocab, self.unk, self.prefix, self.max_chars = vocab, unk, prefix, max_chars
        self.unk_id = vocab[unk]
        #: the first piece of a word may be any entry, also one that looks like a continuation
        self.first = {t: i for t, i in vocab.items() if t}
        self.rest = {t[len(prefix) :]: i for t, i in vocab.items() if t.startswith(prefix) and len(t) > len(prefix)}
        self._longest = tuple(max(map(len, d), default=0) for d in (self.first, self.rest))

    @classmethod
    def from_spec(cls, spec: dict) -> WordPiece:
        kind = spec.get("type")
        if kind != "WordPiece" and not (kind is None and "merges" not in spec and "max_input_chars_per_word" in spec):
            raise UnsupportedTokenizerError(f"model {kind!r}")
        if not isinstance(spec.get("vocab"), dict):
            raise ValueError("a WordPiece model needs a vocab")
        return cls(spec["vocab"], spec.get("unk_token", "[UNK]"), spec.get("continuing_subword_prefix", "##"), spec.get("max_input_chars_per_word", 100))

    def tokenize(self, word: str) -> list[int]:
        n = len(word)
        if n > self.max_chars:
            return [self.unk_id]
        out, start, table, longest = [], 0, self.first, self._longest[0]
        while start < n:
            for end in range(min(n, start + longest), start, -1):
                found = table.get(word[start:end])
                if found is not None:
                    break
            else:
                return [self.unk_id]
            out.append(found)
            start, table, longest = end, self.rest, self._longest[1]
        return out
