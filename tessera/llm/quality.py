"""Quality rules: base counts, and divergence of character classes and common words from language references.

Pass one makes the references: for each language with a list of common words here, the mean histogram of character
classes and of common words over all documents of that `lang` that pass the base rules and are long enough. It is summed
in whole millionths, so the sums don't depend on the order of tasks. Three statistics compare a document with the nearest
reference: the Jensen-Shannon distances (base 2, 0 to 1) of its character classes, and of its common words among
themselves, and the share of its words that are common ones. The nearest reference counts, not the one of the document's
own lang, as labels err.

Pass two takes their limits from the references' own documents: for each language and class of length (short texts differ
more by chance), median plus or minus SPREADS robust standard deviations (1.4826 times the median absolute deviation), of
all documents that pass the base rules. Up to half of them may be junk without moving the limits far, and no limit is
fitted to a corpus by hand. What reaches the driver is a vector for each of at most four languages, and at most BINS
counts for each statistic, language and class of length. Pass three is the verdict.

Classes of characters know scripts: Latin letters have classes of their own, other letters are one, so a Cyrillic text is
far from every reference here. Documents under MIN_CHARS or MIN_WORDS aren't compared, nor are those whose lang is null
or has no reference, as it has no list or fewer than MIN_DOCS documents: other languages say nothing about them. A class of
length with fewer than MIN_DOCS documents goes by the limits of the next shorter one that has more, without any it isn't
compared. Fewer than MIN_COMMON common words are no distribution: such a text is judged by its share and characters,
against the reference of its own lang.

Defined results: a null text has no words and fails the base rules; null and repeated doc_ids pass through, a row for
each row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, mapped, pieces

COMMON = {
    "en": "the of and to a in is it that was for on are with as be this have from or by not but what all were when your can an each which do how their if will than",
    "de": "der die das und in zu den von ist mit sich des auf für nicht es dem im eine ein an auch als war oder bei wie nach so aber aus wird noch nur einer sie ich er",
    "fr": "le la les de des du et un une en est que qui dans pour pas au sur se plus par ce il elle avec ne son sont aux mais ou nous vous cette ses leur on",
    "es": "el la los las de del y que en un una por con no se su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me",
}
SYMBOLS = "#*$%&|<>"
MIN_CHARS, MIN_WORDS, MIN_DOCS, MIN_COMMON = 200, 50, 20, 10
#: Robust standard deviations from the median that are kept, and the least that each statistic's is taken for: prose is
#: so even in its characters that a number or two would count as far off.
SPREADS, LEAST = 5, (0.03, 0.01, 0.01)
BINS = 2000
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "punctuation", "symbol", "letter", "other")
_STRIP = b".,;:!?\"'()[]"
_UNIT = 1_000_000
_LONGEST = 5


@lru_cache(1)
def common_words() -> dict[bytes, int]:
    return {w.encode(): i for i, w in enumerate(sorted({w for words in COMMON.values() for w in words.split()}))}


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point below 0x3000; what lies above counts as a letter of another script."""
    out = np.full(0x3001, 8, np.uint8)
    for c in range(0x3000):
        x, kind = chr(c), unicodedata.category(chr(c))
        latin = "LATIN" in unicodedata.name(x, "")
        out[c] = 2 if kind[0] == "N" else 4 if x in "\t\n\x0b\x0c\r" else 3 if kind[0] == "Z" else 5 if x in ".,;:!?" else 6 if x in "'\"()-[]" else 7 if kind[0] in "PS" else (0 if latin and kind != "Lu" else 1 if latin else 8) if kind[0] in "LM" else 9
    return out


def length_class(n_words: int) -> int:
    return min(_LONGEST, (n_words // MIN_WORDS).bit_length() - 1)


def histograms(texts: list[str], words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the shares of the character classes, and the counts of the common words."""
    sizes = [len(t) for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)) * len(CLASSES), sizes)
    chars = np.bincount(row + class_table()[np.minimum(points, 0x3000)], minlength=len(texts) * len(CLASSES)).reshape(-1, len(CLASSES)).astype(float)
    table = common_words()
    n = len(table)
    get, out = table.get, np.zeros((len(texts), n))
    for i, ws in enumerate(words):
        out[i] = np.bincount([get(w.strip(_STRIP).lower(), n) for w in ws], minlength=n + 1)[:n]
    return chars / np.maximum(1, chars.sum(1, keepdims=True)), out


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between each row of p and each of q."""
    p, q = p[:, None, :], q[None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that stand twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    pair = code[:-2] * m + code[1:-1]
    if m >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    three = pair * m + code[2:]
    order = np.argsort(three, kind="stable")
    same = three[order[1:]] == three[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if not text:
        return 0, 0, 0, 0, 0, True
    n = len(words)
    dup = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line.strip(BLANKS):
                dup += line in seen
                seen.add(line)
    repeat = repeated_words(words)
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeat, n < 50 or 100 * repeat > 50 * n


class References:
    """Languages and their mean histograms, and the limits of each language and class of length."""

    def __init__(self, means: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(means)
        self.chars, self.common = (np.array([means[x][i] for x in self.langs]) for i in (0, 1)) if means else (None, None)
        #: (language, class of length) to the largest distances and the least share
        self.limits: dict[tuple[str, int], tuple[float, float, float]] = {}

    def statistics(self, texts: list[str], words: list[list[bytes]], langs: list[str]) -> list[tuple[str, int, float, float | None, float]]:
        """(language, class of length, character distance, word distance or None, share) of each text. The language is the
        nearest by common words, or the text's own where it has too few of them."""
        out = []
        for at in range(0, len(texts), 256):
            part, own = texts[at : at + 256], words[at : at + 256]
            chars, common = histograms(part, own)
            total = common.sum(1)
            char = np.round(js_distances(chars, self.chars), 9)
            word = np.round(js_distances(common / np.maximum(1, total)[:, None], self.common), 9)
            for i, ws in enumerate(own):
                enough = total[i] >= MIN_COMMON
                k = int(word[i].argmin()) if enough else self.langs.index(langs[at + i])
                out.append((self.langs[k], length_class(len(ws)), float(char[i, k]), float(word[i, k]) if enough else None, round(float(total[i]) / len(ws), 9)))
        return out

    def limits_of(self, lang: str, size: int) -> tuple[float, float, float] | None:
        """Those of the class of length, or of the next shorter one that has any, which are wider."""
        return next((self.limits[lang, k] for k in range(size, -1, -1) if (lang, k) in self.limits), None)

    @staticmethod
    def within(limits: tuple[float, float, float], char: float, word: float | None, share: float) -> bool:
        most_char, most_word, least_share = limits
        return char <= most_char and (word is None or word <= most_word) and share >= least_share


def comparable(texts: list[str | None], words: list[list[bytes]], langs: list[str | None], known) -> list[int]:
    """Places of the texts that are long enough and of a known language."""
    return [i for i, (t, ws, lang) in enumerate(zip(texts, words, langs)) if lang in known and len(ws) >= MIN_WORDS and len(t) >= MIN_CHARS]


def split(texts: list[str | None]) -> list[list[bytes]]:
    return [t.encode().split() if t else [] for t in texts]


def means(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language to mean histograms, from all documents that pass the base rules; rows: text, lang."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in pieces(batch, "text"):
                words, own = split(texts), langs[first : first + len(texts)]
                at = [i for i in comparable(texts, words, own, COMMON) if 100 * repeated_words(words[i]) <= 50 * len(words[i])]
                chars, common = histograms([texts[i] for i in at], [words[i] for i in at])
                for i, c, w in zip(at, chars, common):
                    found = np.concatenate([c, w / len(words[i])]) * _UNIT
                    if own[i] not in sums:
                        sums[own[i]] = np.zeros(len(found) + 1, np.int64)
                    sums[own[i]] += np.append(np.rint(found).astype(np.int64), 1)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(v)), "pos": pa.array(range(len(v)), pa.int32()), "total": pa.array(v)})

    found: dict[str, dict[int, int]] = {}
    for r in mapped(rows, run, "lang string, pos int, total bigint").groupBy("lang", "pos").agg(F.sum("total").alias("total")).collect():  # at most 4 languages of fixed width
        found.setdefault(r.lang, {})[r.pos] = r.total
    out = {}
    for lang, v in found.items():
        *mean, n = (v[i] for i in range(len(v)))
        chars, common = np.array(mean[: len(CLASSES)], float), np.array(mean[len(CLASSES) :], float)
        if n >= MIN_DOCS and common.sum():
            out[lang] = chars / chars.sum(), common / common.sum()
    return out


def limit(counts: dict[int, int], side: int, least: float) -> float:
    """Median plus (side 1) or minus (-1) SPREADS robust deviations, of `least` or more; counts: bin to number."""
    bins = np.array(sorted(counts))
    n = np.array([counts[b] for b in bins])

    def median(values: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    values = bins / BINS
    middle = median(values)
    return middle + side * SPREADS * max(least, 1.4826 * median(np.abs(values - middle)))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Means and limits from all documents that pass the base rules."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    refs = References(means(rows))
    if not refs.langs:
        return refs

    def run(batches):
        counts: dict[tuple[str, int, int, int], int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in pieces(batch, "text"):
                words, own = split(texts), langs[first : first + len(texts)]
                at = [i for i in comparable(texts, words, own, refs.langs) if 100 * repeated_words(words[i]) <= 50 * len(words[i])]
                for lang, size, *values in refs.statistics([texts[i] for i in at], [words[i] for i in at], [own[i] for i in at]):
                    for k, v in enumerate(values):
                        if v is not None:
                            key = lang, size, k, round(v * BINS)
                            counts[key] = counts.get(key, 0) + 1
        cols = list(zip(*((*k, n) for k, n in counts.items()))) or [()] * 5
        yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("lang", "size", "kind", "bin", "n"), cols, (pa.string(), *[pa.int32()] * 3, pa.int64()))})

    held: dict[tuple[str, int], list[dict[int, int]]] = {}
    for r in mapped(rows, run, "lang string, size int, kind int, bin int, n bigint").groupBy("lang", "size", "kind", "bin").agg(F.sum("n").alias("n")).collect():  # 4 languages, 6 lengths, 3 statistics, BINS + 1 at most
        held.setdefault((r.lang, r["size"]), [{}, {}, {}])[r.kind][r.bin] = r.n
    for key, (char, word, share) in held.items():
        if sum(char.values()) >= MIN_DOCS:
            refs.limits[key] = limit(char, 1, LEAST[0]), limit(word, 1, LEAST[1]) if word else 1.0, limit(share, -1, LEAST[2])
    return refs


def verdicts(refs: References, texts: list[str | None], words: list[list[bytes]], own: list[str | None]) -> list[tuple]:
    """(ref_lang, char_distance, word_distance, common_share, ok) of each text; nulls where nothing is compared."""
    out: list[tuple] = [(None, None, None, None, True)] * len(texts)
    at = comparable(texts, words, own, refs.langs)
    for i, (lang, size, char, word, share) in zip(at, refs.statistics([texts[i] for i in at], [words[i] for i in at], [own[i] for i in at])):
        if limits := refs.limits_of(lang, size):
            out[i] = lang, char, word, share, refs.within(limits, char, word, share)
    return out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and ref_lang,
    char_distance, word_distance and common_share (null where nothing is compared)."""
    refs = references(docs, text_col, lang_col)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ref_lang", "char_distance", "word_distance", "common_share"]

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in pieces(batch, "text"):
                words, rows = split(texts), []
                for text, own, found in zip(texts, words, verdicts(refs, texts, words, langs[first : first + len(texts)])):
                    counts = base(text, own)
                    rows.append((*counts, found[-1] and not counts[-1], *found[:-1]))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kinds = [docs.schema[id_col].dataType.simpleString()] + ["bigint"] * 5 + ["boolean"] * 2 + ["string"] + ["double"] * 3
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that the rules keep; judged row by row, without a join."""
    refs = references(docs, text_col, lang_col)

    def run(batches):
        for batch in batches:
            keep = []
            langs = batch.column(lang_col).to_pylist()
            for first, texts in pieces(batch, text_col):
                words = split(texts)
                found = verdicts(refs, texts, words, langs[first : first + len(texts)])
                keep += [v[-1] and not base(t, ws)[-1] for t, ws, v in zip(texts, words, found)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
