"""Errors of tokenizer definitions."""


class UnsupportedTokenizerError(ValueError):
    """A well-formed definition with a component this engine does not run."""
