"""Tokenizer definitions: the parsed form of a tokenizer.json, and the runtime made from it on each worker."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any

from tessera.errors import UnsupportedTokenizerError
from tessera.functions.added_tokens import AddedToken, AddedTokens
from tessera.functions.decoders import Decoder
from tessera.functions.normalizers import compile_normalizer
from tessera.functions.pretokenizers import compile_pre_tokenizer, splits_on_blanks
from tessera.functions.wordpiece import WordPiece

_BLANK = re.compile(r"[ \t\n\r]")
_CHUNKS = re.compile(r"[^ \t\n\r]+")
#: What str.split() parts at as well: some of it is no white space here, some vanishes in normalizing.
_OTHER_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a memo where a tokenizer sets none of its own.
DEFAULT_MEMO = int(os.environ.get("TESSERA_MEMO_ENTRIES") or 1 << 19)
#: Most bytes of each of a runtime's two memos, about: whatever the texts, a worker holds no more than twice that.
MEMO_BYTES = 64 << 20
#: Bytes of an entry besides its key and value.
_ENTRY = 48
#: Bytes of an id, characters of the longest piece that is kept in the memo, and of a text that is worked at once.
ID, KEPT, AT_ONCE = 4, 64, 1 << 20


@dataclass(frozen=True)
class Template:
    """Special tokens around the content, and the types of all three."""

    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()
    prefix_types: tuple[int, ...] = ()
    suffix_types: tuple[int, ...] = ()
    content_type: int = 0

    @classmethod
    def from_spec(cls, spec: dict | None) -> Template:
        if spec is None:
            return cls()
        kind = spec.get("type")
        if kind in ("BertProcessing", "RobertaProcessing"):
            ends = []
            for name in ("cls", "sep"):
                pair = spec.get(name)
                if not isinstance(pair, (list, tuple)) or len(pair) < 2 or not isinstance(pair[1], int):
                    raise ValueError(f"post_processor {name} must be a token and its id")
                ends.append((pair[1],))
            return cls(ends[0], ends[1], (0,), (0,))
        if kind != "TemplateProcessing":
            raise UnsupportedTokenizerError(f"post_processor {kind!r}")
        sides: list[list[tuple[int, int]]] = [[], []]
        content = None
        for part in spec.get("single") or []:
            if "Sequence" in part:
                if content is not None or part["Sequence"].get("id") != "A":
                    raise UnsupportedTokenizerError("the single template must hold $A once")
                content = part["Sequence"].get("type_id", 0)
            elif "SpecialToken" in part:
                name = part["SpecialToken"].get("id")
                ids = ((spec.get("special_tokens") or {}).get(name) or {}).get("ids")
                if not isinstance(ids, list):
                    raise ValueError(f"the template's {name!r} has no ids")
                sides[content is not None] += [(i, part["SpecialToken"].get("type_id", 0)) for i in ids]
            else:
                raise ValueError("a template part is neither a sequence nor a special token")
        if content is None:
            raise UnsupportedTokenizerError("the single template has no $A")
        (a, b), (c, d) = ((tuple(i for i, _ in s), tuple(t for _, t in s)) for s in sides)
        return cls(a, c, b, d, content)


class Memo(dict):
    """Strings and their ids as bytes; full, it admits no more. It never changes a result."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.most, self.room = find, most, MEMO_BYTES

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= KEPT and len(self) < self.most and self.room > 0:
            self.room -= sys.getsizeof(key) + sys.getsizeof(found) + _ENTRY
            self[key] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.room = MEMO_BYTES


def chunks(text: str) -> list[str]:
    """What spaces, tabs, line feeds and returns part."""
    other = any(map(text.__contains__, _OTHER_BLANKS)) or not text.isascii() and any(map(text.__contains__, _WIDE_BLANKS))
    return _CHUNKS.findall(text) if other else text.split()


class Runtime:
    """Encodes and decodes single texts."""

    def __init__(self, definition: dict, memo_entries: int = DEFAULT_MEMO):
        if not isinstance(definition, dict) or not isinstance(definition.get("model"), dict):
            raise ValueError("a tokenizer definition needs a model")
        self.definition = definition
        self.model = WordPiece.from_spec(definition["model"])
        self.normalize = compile_normalizer(definition.get("normalizer"))
        self.pre_tokenize = compile_pre_tokenizer(definition.get("pre_tokenizer"))
        self.added = AddedTokens(filter(None, map(AddedToken.from_spec, definition.get("added_tokens") or [])), self.normalize)
        self.template = Template.from_spec(definition.get("post_processor"))
        self.decoder = Decoder(definition.get("decoder"))
        self.by_id = {i: t for t, i in self.model.vocab.items()}
        # texts may be cut at these separators if they survive as blanks, no piece holds a blank, and no added token
        # is looked for after normalizing, where it might lie across one
        blank = all(n and n.isspace() for n in map(self.normalize, " \t\n\r"))
        self.chunkable = blank and splits_on_blanks(definition.get("pre_tokenizer")) and self.added.late is None
        #: the same for texts with added tokens that are looked for before
        self.cuttable = self.chunkable and not any(_BLANK.search(t.content) for t in self.added.tokens)
        #: what becomes of Latin-1 characters; no step looks at the neighbours of one
        self._latin = str.maketrans({c: self.normalize(c) for c in map(chr, range(256))})
        self._pieces = Memo(lambda piece: array("i", self.model.tokenize(piece)).tobytes(), memo_entries)
        self._chunks = Memo(self._segment, memo_entries)

    def clear_memo(self) -> None:
        self._pieces.clear()
        self._chunks.clear()

    def normalized(self, text: str) -> str:
        """normalize(), by a table where it can be."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.normalize(text)
        return text.translate(self._latin)

    def _windows(self, text: str) -> Iterator[str]:
        """A long text in parts that end before a blank, where it may be cut."""
        start = 0
        while self.cuttable and len(text) - start > AT_ONCE and (m := _BLANK.search(text, start + AT_ONCE)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def _segment(self, text: str) -> bytes:
        """Ids of a text without added tokens that are looked for before normalizing."""
        get, out = self._pieces.__getitem__, []
        for part in self.added.split(self.normalized(text), self.added.late):
            out.append(array("i", (part,)).tobytes() if isinstance(part, int) else b"".join(map(get, self.pre_tokenize(part))))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of the text without special tokens, as 32-bit integers of the machine's order."""
        get, out = self._chunks.__getitem__, []
        for window in self._windows(text):
            for part in self.added.split(window, self.added.raw):
                if isinstance(part, int):
                    out.append(array("i", (part,)).tobytes())
                else:
                    out.append(b"".join(map(get, chunks(part))) if self.chunkable else self._segment(part))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_some(self, text: str, room: int, side: str = "right") -> bytes:
        """The first `room` ids of the text, or the last ones if the left is cut, without working much more of it."""
        size = 8 * room + 64
        while self.cuttable and size < len(text):
            if side == "right":
                m = _BLANK.search(text, size)
                part = text[: m.start()] if m else text
            else:
                part = text[max(text.rfind(c, 0, len(text) - size) for c in " \t\n\r") + 1 :]
            found = self.encode_bytes(part)
            if len(found) >= room * ID:
                break
            size *= 4
        else:
            found = self.encode_bytes(text)
        return found[: room * ID] if side == "right" else found[max(0, len(found) - room * ID) :]

    def encode(self, text: str) -> list[int]:
        """Ids of the text without special tokens."""
        return array("i", self.encode_bytes(text)).tolist()

    def assembled(self, ids: list[int], special: bool = True, max_length: int | None = None, side: str = "right") -> list[int]:
        t = self.template if special else Template()
        room = room_for_content(t, max_length)
        if room is not None and len(ids) > room:
            ids = ids[:room] if side == "right" else ids[len(ids) - room :]
        return [*t.prefix, *ids, *t.suffix]

    def token_to_id(self, token: str) -> int | None:
        found = self.added.by_content.get(token)
        return self.model.vocab.get(token) if found is None else found

    def id_to_token(self, number: int) -> str | None:
        found = self.added.decoded.get(number)
        return self.by_id.get(number) if found is None else found

    def tokens(self, ids: Iterable[int], skip_special: bool = False) -> list[str]:
        found = (self.id_to_token(i) for i in ids)
        return [t for t in found if t is not None and not (skip_special and self.added.is_special(t))]

    def decode(self, ids: Iterable[int], skip_special: bool = False) -> str:
        return self.decoder.decode(self.tokens(ids, skip_special))

    def vocab(self, with_added: bool = True) -> dict[str, int]:
        return self.model.vocab | (self.added.by_content if with_added else {})


def room_for_content(template: Template, max_length: int | None) -> int | None:
    """Content ids that fit max_length, special tokens taken off."""
    if max_length is None:
        return None
    n = len(template.prefix) + len(template.suffix)
    if max_length < n:
        raise ValueError(f"max_length={max_length} leaves no room for the {n} special tokens")
    return max_length - n


@lru_cache(8)
def runtime_of(text: str, memo_entries: int = DEFAULT_MEMO) -> Runtime:
    """The runtime of a definition, once per process."""
    return Runtime(json.loads(text), memo_entries)


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer.json and the settings beside it. Small and picklable: this is what travels to the workers."""

    text: str
    config: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)
    memo_entries: int = DEFAULT_MEMO

    @cached_property
    def runtime(self) -> Runtime:
        return runtime_of(self.text, self.memo_entries)

    def __getstate__(self) -> dict:
        return {"text": self.text, "config": self.config, "memo_entries": self.memo_entries}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            object.__setattr__(self, k, v)
