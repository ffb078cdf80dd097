"""Decoders: token strings to text."""

from __future__ import annotations

from tessera.errors import UnsupportedTokenizerError

#: applied in this order, to each piece and not to the joined text
CLEANUPS = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def replaced(text: str, pairs=CLEANUPS) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text


class Decoder:
    """WordPiece decoding, or joining with spaces where prefix is None."""

    def __init__(self, spec: dict | None):
        if spec is not None and spec.get("type") != "WordPiece":
            raise UnsupportedTokenizerError(f"decoder {spec.get('type')!r}")
        self.prefix = None if spec is None else spec.get("prefix", "##")
        self.cleanup = spec is not None and spec.get("cleanup", True)

    def decode(self, tokens: list[str]) -> str:
        if self.prefix is None:
            return " ".join(tokens)
        pieces = [t if not k else t[len(self.prefix) :] if t.startswith(self.prefix) else f" {t}" for k, t in enumerate(tokens)]
        return "".join(map(replaced, pieces) if self.cleanup else pieces)
