"""Added tokens: literals that are found before the model sees the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from . import unicode as U


#: Tokens that are looked for one by one before the pattern is tried.
_FEW = 16


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    special: bool = False
    normalized: bool = True
    # what may stand around a match
    rstrip: bool = False
    lstrip: bool = False
    single_word: bool = False

    @classmethod
    def from_spec(cls, spec: dict) -> AddedToken | None:
        content, number = spec.get("content"), spec.get("id")
        if not isinstance(content, str):
            raise ValueError("an added token has no content")
        if not isinstance(number, int) or isinstance(number, bool) or not 0 <= number < 1 << 31:
            raise ValueError(f"added token {content!r} has no valid id")
        special = bool(spec.get("special", False))
        flags = {k: bool(spec.get(k, False)) for k in ("single_word", "lstrip", "rstrip")}
        return cls(number, content, **flags, normalized=bool(spec.get("normalized", not special)), special=special) if content else None


class AddedTokens:
    def __init__(self, tokens: Iterable[AddedToken], normalize: Callable[[str], str]):
        self.tokens = list(tokens)
        self.by_content = {t.content: t.id for t in self.tokens}
        by_id = {t.id: t for t in self.tokens}
        self.by_id = by_id
        forms = {t.id: normalize(t.content) if t.normalized else t.content for t in self.tokens}
        #: what an id decodes to: a normalized token in its normalized form
        self.decoded = {i: forms[i] for i in by_id}
        self.raw = self._matcher({t.content: t for t in self.tokens if not t.normalized})
        self.late = self._matcher({forms[t.id]: t for t in self.tokens if t.normalized and forms[t.id]})

    @staticmethod
    def _matcher(held: dict[str, AddedToken]):
        if not held:
            return None
        # leftmost, then longest: alternatives from long to short
        return re.compile("|".join(map(re.escape, sorted(held, key=len, reverse=True)))), held

    def is_special(self, content: str) -> bool:
        number = self.by_content.get(content)
        return number is not None and self.by_id[number].special

    def split(self, text: str, matcher) -> list[str | int]:
        """Text parts and ids of the tokens between them."""
        if matcher is None:
            return [text] if text else []
        pattern, held = matcher
        if len(held) <= _FEW and not any(map(text.__contains__, held)):
            return [text] if text else []
        word, blank = U.char_class("word"), U.char_class("space")
        out: list[str | int] = []
        done = 0
        for m in pattern.finditer(text):
            token, start, stop = held[m[0]], m.start(), m.end()
            if token.single_word:
                is_word = U.compiled(f"[{word}]").match
                if start and is_word(text[start - 1]) or stop < len(text) and is_word(text[stop]):
                    continue
            if token.lstrip:
                back = U.compiled(f"[{blank}]").match
                while start > done and back(text[start - 1]):
                    start -= 1
            if token.rstrip:
                stop = U.compiled(f"[{blank}]*").match(text, stop).end()
            if done < start:
                out.append(text[done:start])
            out.append(token.id)
            done = stop
        if done < len(text):
            out.append(text[done:])
        return out
