"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are counts of hashed 1- to 3-grams of code points of the lower-cased whole text, times the inverse document
frequency, scaled to length one; they are sparse rows throughout. Document frequencies are counted over all documents
that may be learnt from, as a vector of DIMENSIONS. The classifier is fitted with follow-the-regularised-leader
(per-coordinate rates, elastic net) on a bounded sample of labelled rows: about SAMPLE of each language, and MOST of all
together, chosen by a hash of the id. A fifth of them is kept out: of the strengths of L1 the greatest one whose loss there
is within SLACK of the least is taken, so that most weights are zero, and the temperature that calibrates the
probabilities is fitted there. What is broadcast are the n-grams with a weight that isn't zero; it has a fixed bound,
whatever the input's size.

lang, source and id are not inputs of a prediction. Rows whose crc32(id as text) mod 3 is 1 are held out: neither counts
nor sample use them, nor rows with a null lang, text or id.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text when there is nothing to
learn from; null ids are neither held out nor learnt from; repeated rows count each time; ties go to the language that
sorts first; other columns are ignored; an empty table gives an empty result. Very long texts are counted part by part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, pieces

DIMENSIONS = 1 << 15
#: Learnt-from rows of each language, about, and of all languages together.
SAMPLE, MOST = 1000, 8000
EPOCHS, ALPHA, BETA, L2 = 3, 1.0, 1.0, 1e-4
#: Strengths of L1 that are tried, and how much more loss than the least a sparser fit may have.
L1, SLACK = (0.03, 0.1, 0.3), 1.1
_HELD = "coalesce(crc32(cast(cast({0} as string) as binary)) % 3 = 1, false)"
_GROUP_CHARS, _GROUP_ROWS = 400_000, 4096
_U = np.uint64


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(texts: list[str], starts: int | None = None) -> np.ndarray:
    """Row number * DIMENSIONS + bucket of each n-gram of lower-cased texts; of those that start before `starts` only."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out, h = [], points * _U(0x9E3779B97F4A7C15)
    for n in range(3):
        if n:
            h = (h[:-1] ^ (h[:-1] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + points[n:] * _U(0x94D049BB133111EB)
        if not len(h):
            break
        place = ((h ^ (h >> _U(31))) >> _U(33 - n)).astype(np.int64) % DIMENSIONS + row[: len(h)] * DIMENSIONS
        out.append((place[row[: len(h)] == row[n:]] if n else place)[:starts])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed n-gram counts: each entry's row, bucket and count, in order."""
    lowered = [t.lower() for t in texts]
    if len(texts) == 1 and len(lowered[0]) > _GROUP_CHARS:
        total = np.zeros(DIMENSIONS, np.int64)
        for at in range(0, len(lowered[0]), _GROUP_CHARS):  # n-grams that begin in this part
            total += np.bincount(buckets([lowered[0][at : at + _GROUP_CHARS + 2]], _GROUP_CHARS), minlength=DIMENSIONS)
        place = np.flatnonzero(total)
        return np.zeros(len(place), np.int64), place, total[place].astype(np.float32)
    keys = np.sort(buckets(lowered))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    return keys[first] // DIMENSIONS, keys[first] % DIMENSIONS, n.astype(np.float32)


def groups(texts: list[str]):
    """Runs of rows that are counted together, long ones alone: (first, texts)."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and (held + len(t) > _GROUP_CHARS or i - first >= _GROUP_ROWS):
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]


def features(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of length one: each entry's row, bucket and value."""
    row, at, n = counts(texts)
    x = n * idf[at]
    norm = np.sqrt(np.bincount(row, x * x, len(texts)))
    return row, at, (x / np.maximum(norm, 1e-9)[row]).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    def run(batches):
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                for _, group in groups(texts):
                    n += len(group)
                    df += np.bincount(counts(group)[1], minlength=DIMENSIONS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(-1, at), pa.int32()), "n": pa.array(np.append(n, df[at]), pa.int64())})

    parts = mapped(docs.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIMENSIONS), 0
    for r in parts.collect():  # DIMENSIONS + 1 rows at most
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return total, df


class Ftrl:
    """FTRL-proximal for a softmax over classes; coordinates are touched only where a document has features."""

    def __init__(self, classes: int, l1: float):
        self.z, self.l1 = np.zeros((DIMENSIONS + 1, classes)), l1
        self.n = np.zeros_like(self.z)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """What a prediction needs: languages, idf, the buckets with weights and these, bias and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.bias, self.temperature = langs, idf, weights[-1], temperature
        self.used = np.flatnonzero(weights[:-1].any(1))
        self.weights = weights[self.used].astype(np.float32)
        self.slot = np.full(DIMENSIONS, -1, np.int32)
        self.slot[self.used] = np.arange(len(self.used))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        row, at, x = features(texts, self.idf)
        slot = self.slot[at]
        known = slot >= 0
        row, x, w = row[known], x[known], self.weights[slot[known]]
        scores = np.stack([np.bincount(row, x * w[:, c], len(texts)) for c in range(len(self.langs))], 1)
        return softmax((scores + self.bias) / self.temperature)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model, or None if there is nothing to learn from. docs: doc_id, text, lang."""
    may = docs.where(f"not {_HELD.format('doc_id')} and doc_id is not null and lang is not null and text is not null")
    sizes = {r.lang: r.n for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    total, df = document_frequencies(may)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    each = min(sample, MOST / len(langs))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    chosen = may.where((F.xxhash64("doc_id", F.lit("sample")).cast("double") / float(2**64) + 0.5) < share[F.col("lang")])

    def run(batches):
        for batch in batches:
            lang, order = batch.column("lang"), batch.column("order")
            for first, texts in pieces(batch, "text"):
                for k, group in groups(texts):
                    row, at, x = features(group, idf)
                    cut = np.searchsorted(row, np.arange(1, len(group)))
                    ats, xs = np.split(at.astype(np.int32), cut), np.split(x, cut)
                    yield pa.RecordBatch.from_pydict({"lang": lang.slice(first + k, len(group)), "order": order.slice(first + k, len(group)), "at": pa.array([a.tobytes() for a in ats], pa.binary()), "x": pa.array([v.tobytes() for v in xs], pa.binary())})

    rows = mapped(chosen.select("text", "lang", F.xxhash64("doc_id", F.lit("order")).alias("order")), run, "lang string, order bigint, at binary, x binary").collect()  # the bounded sample
    rows.sort(key=lambda r: (r.order, r.lang, r.x))
    data = [(np.append(np.frombuffer(r["at"], np.int32), DIMENSIONS), np.append(np.frombuffer(r["x"], np.float32), np.float32(1)), langs.index(r.lang)) for r in rows]
    held = data[::5] if len(data) >= 50 else []
    train = [d for i, d in enumerate(data) if i % 5] if held else data
    fits = []
    for l1 in L1 if held else L1[:1]:
        model = Ftrl(len(langs), l1)
        for _ in range(EPOCHS):
            for d in train:
                model.learn(*d)
        w = model.weights()
        t, loss = temperature([(x @ w[at], label) for at, x, label in held])
        fits.append((loss, l1, t, w))
    least = min(f[0] for f in fits)
    _, _, t, w = max((f for f in fits if f[0] <= SLACK * least), key=lambda f: f[1])
    return Model(langs, idf, w, t)


def temperature(held: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """The temperature of the least loss on the held rows, by golden-section search, and this loss."""
    if not held:
        return 1.0, 0.0
    scores, labels = np.array([s for s, _ in held]), np.array([y for _, y in held])

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2)), loss((lo + hi) / 2)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows, sample)

    def run(batches):
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for first, texts in pieces(batch, "text"):
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if model:
                    for k, group in groups([x or "" for x in texts]):
                        p = model.probabilities(group)
                        for i, (text, best) in enumerate(zip(group, p.argmax(1))):
                            if has_letter(text):
                                pred[k + i], score[k + i] = model.langs[best], float(p[i, best])
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(texts)), "held_out": held.slice(first, len(texts)), "lang_pred": pa.array(pred), "score": pa.array(score)})

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return mapped(rows.select("doc_id", "text", F.expr(_HELD.format("doc_id")).alias("held_out")), run, schema)
