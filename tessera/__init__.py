"""Tessera: a Spark-first text tokenization engine over DataFrames of documents."""

from tessera.compat import BatchEncoding, CallStyle
from tessera.errors import UnsupportedTokenizerError
from tessera.plans.spec import Runtime, TokenizerSpec
from tessera.ragged import RaggedIds
from tessera.sources.files import JsonLines, TextFiles
from tessera.tokenizer import Tokenizer

__all__ = ["BatchEncoding", "CallStyle", "JsonLines", "RaggedIds", "Runtime", "TextFiles", "Tokenizer", "TokenizerSpec", "UnsupportedTokenizerError"]
