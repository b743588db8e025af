"""Token counts: pieces are counted once per distinct pre-token, then summed by frequency.

Pre-tokens are the runs that begin at white space: no piece of the vocabulary goes on across a
space, so the merges of a text never cross from one run into the next, and the count of a text
is the sum over its runs. Each task keeps the counts of the distinct pre-tokens it has met,
joins them by hash to the (row, pre-token) frequencies of a slice of texts, and sums. The
tokenizer sees each distinct pre-token once; no ids are kept and nothing is shuffled. (A
cluster-wide join of pre-tokens would shuffle about as many bytes as the texts have.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm import textbytes

#: Distinct pre-tokens whose counts a worker remembers; it starts anew beyond (bounds memory only).
REMEMBERED = 400_000
SPACE_MARK = "▁".encode()
_known: dict[str, dict[bytes, int]] = {}
_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _counts(model, texts: list[str]) -> list[int]:
    return [len(ids) for ids in model.encode(texts, num_threads=1)]


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text; null counts as empty."""
    model, known = _model(path), _known.setdefault(path, {})
    total = np.zeros(len(texts), np.int64)
    for first, end, data, offsets in textbytes.text_slices(texts):
        if not len(data):
            continue
        starts, ends, rows = textbytes.spaced(data, offsets)
        # The model itself puts a space before a text: a run inside the text goes without its own.
        inside = starts != offsets[rows]
        starts = starts + inside
        where, back = textbytes.Hasher(data).groups(starts, ends)
        raw = data.tobytes()
        names = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        counts = list(map(known.get, names))
        missing = [i for i, c in enumerate(counts) if c is None]
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
        found = _counts(model, [names[i].decode("utf-8", "replace") for i in missing])
        for i, n in zip(missing, found, strict=True):
            # A single space inside a text, with no word after it, is one piece.
            counts[i] = known[names[i]] = n if names[i] else 1
        sums = np.bincount(rows, np.array(counts, np.int64)[back], end - first)
        total[first:end] = sums.astype(np.int64)
    # The mark that stands for a space in the vocabulary may join with spaces around it.
    marked = pc.fill_null(pc.match_substring(texts, SPACE_MARK.decode()), False)
    for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
        total[i] = len(model.encode(texts[int(i)].as_py()))
    return total


def token_counts(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `documents` (doc_id, text).

    One row out per row in, repeated rows and null ids included; a null text counts as empty
    (0 bytes, 0 tokens). Further columns are ignored. No truncation, no special tokens.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(count_texts(batch.column(2), path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(documents.dtypes)["doc_id"]
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return (
        documents.select("doc_id", length, "text")
        .mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
