"""SentencePiece encoding and decoding with a merge-type prefix table (see token_pieces).

encode() works on whole texts, row by row; memory is a batch of text and a bounded memo of units. Nothing is shuffled,
so a lost executor costs only its tasks.

Defined results: a null text is encoded as an empty one (only the end id); null and repeated doc_ids pass through, one
result row for each input row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import mapped, pieces
from .token_pieces import UnitMemo, hexdigest, piece_model


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and decoded text themselves if `ids`.

    The end id closes every document; decoded is the library's decode of all ids."""

    def run(batches):
        model = piece_model(model_path)
        memo, name = UnitMemo(model), [str(i) for i in range(model.processor.get_piece_size())]
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                rows = []
                for text in texts:
                    found = [i for u in model.units(text or "") for i in memo[u]]
                    found.append(model.eos)
                    decoded = model.processor.decode(found)
                    rows.append((len(found), hexdigest(" ".join(map(name.__getitem__, found)).encode()), hexdigest(decoded.encode()), *((found, decoded) if ids else ())))
                n, a, b, *more = zip(*rows)
                cols = {"doc_id": batch.column("doc_id").slice(first, len(texts)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
                if ids:
                    cols |= {"ids": pa.array(more[0], pa.list_(pa.int32())), "decoded": pa.array(more[1])}
                yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return mapped(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, schema)
