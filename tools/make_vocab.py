"""Write tessera/data/vocab.txt, a small BERT-style vocabulary for tests and queries, from a folder of test tables."""

from __future__ import annotations

import string
import sys
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.functions import normalizers, pretokenizers  # noqa: E402


def main(folder: str) -> None:
    norm, split = normalizers.compile_normalizer({"type": "BertNormalizer"}), pretokenizers.compile_pre_tokenizer({"type": "BertPreTokenizer"})
    words, starts, rests = Counter(), Counter(), Counter()
    for text in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist():
        for w in split(norm(text or "")):
            words[w] += 1
            for n in (2, 3, 4):
                if len(w) > n:
                    starts[w[:n]] += 1
                    rests["##" + w[-n:]] += 1
    chars = [*string.ascii_lowercase, *string.digits, *string.punctuation]
    top = lambda c, n: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *chars, *("##" + c for c in chars), *top(words, 300), *top(starts, 250), *top(rests, 350)]
    target = Path(__file__).resolve().parent.parent / "tessera/data/vocab.txt"
    target.write_text("\n".join(dict.fromkeys(vocab)) + "\n", encoding="utf-8")


if __name__ == "__main__":
    main(sys.argv[1])
