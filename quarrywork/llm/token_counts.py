"""Token counts of whole texts: lengths only, no ids leave the task.

One scan, no exchange. Texts reach the library in batches balanced by bytes
(``pieces_of_work`` outside, ``balanced`` inside); long texts are cut at boundaries no
token crosses. Null text counts as empty (0 bytes, 0 tokens). Repeated rows and null
identifiers are counted like any other row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, per_process, pieces_of_work
from .words import LONG_BYTES, balanced, words_of

LIMIT = 2048


class Pieces:
    """Counts of a sentencepiece model, for texts in an Arrow array."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # A single space between two other characters starts a new word unless some piece
        # reaches over it, or the model strips and joins spaces itself.
        self.splits = (
            not any("▁" in name.lstrip("▁") for name in names)
            and self.model.normalize("  a  b ") == "▁▁▁a▁▁b▁"
        )

    def parts(self, text: str) -> list[str]:
        """Long texts cut at a single space; the space becomes the next part's own prefix."""
        out, at = [], 0
        while self.splits and len(text) - at > LONG_BYTES:
            cut = text.find(" ", at + LONG_BYTES)
            while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def counts(self, texts: pa.Array) -> np.ndarray:
        pieces, owner = [], []
        for k, text in enumerate(texts.to_pylist()):
            for part in self.parts(text):
                pieces.append(part)
                owner.append(k)
        out = np.zeros(len(texts), dtype=np.int64)
        for lo, hi in balanced([len(p) for p in pieces], LONG_BYTES * 16):
            np.add.at(out, owner[lo:hi], [len(ids) for ids in self.model.encode(pieces[lo:hi], num_threads=1)])
        return out


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit for every row.

    ``tokenizer`` is a file of the tokenizers library (``.json``) or of sentencepiece
    (``.model``) that every worker can open. Added tokens spelled inside a text are
    treated as the library does by default.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_work(batches, "text"):
            texts = batch.column("text").fill_null("")
            if tokenizer.endswith(".model"):
                n = per_process(("pieces", tokenizer), lambda: Pieces(tokenizer)).counts(texts)
            else:
                n = words_of(tokenizer).encode(texts, ids=False)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = in_batches(rows, count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
