"""Alignment of two tokenizers on every text: groups of tokens that cover the same bytes, and counts of id pairs.

1. Rows are grouped by their full text. Each distinct text is tokenised by both and aligned once; how often it
   occurs is its weight.
2. Distinct texts are worked off in slices. A slice is one row: the measures of its texts, the distinct id
   pairs of its links with their weighted numbers, and which pairs each text has. It is written once.
3. Pairs are counted over all slices by an ordinary aggregation, and the counts go back to the slices by
   a join on pairs: a pair is one row a slice, however often the slice's texts hold it.
4. The finished measures of a text go to all rows that have it by a join on the text's digest, so that copies
   cost a few bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.lineage import cut, written
from comarca.llm.packing import Vocabulary, token_ids

#: About how many bytes of texts make up a slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: A pair is one number: the id of A, then 32 bits for the id of B.
_B = np.int64(1 << 32)
_models: dict[tuple, tuple] = {}


def _tables(entries: list[bytes]) -> tuple[list[bytes], np.ndarray, list[list[str]]]:
    """Bytes of each id, their numbers, and the id as text with each separator."""
    names = [[f"{i}{sep}" for i in range(len(entries))] for sep in ",|;"]
    return entries, np.array([len(x) for x in entries], np.int64), names


def _byte_level(whole: str) -> tuple:
    """A tokenizer that takes special strings for text, its entries as bytes, and the special strings."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(whole)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    model.encode_special_tokens = True
    # A byte-level entry has a letter for each byte: printable bytes stand for themselves, the others for
    # the letters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    entries = [bytes(letters[c] for c in model.id_to_token(i)) if model.id_to_token(i) not in special else b"" for i in range(model.get_vocab_size())]
    return model, entries, special


def _pieces(path: str) -> tuple:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, entries


def _model(vocabulary: Vocabulary, pieces: str) -> tuple:
    key = (vocabulary.whole, pieces)
    if key not in _models:
        a, entries_a, special = _byte_level(vocabulary.whole)
        b, entries_b = _pieces(pieces)
        _models[key] = a, special, _tables(entries_a), b, _tables(entries_b)
    return _models[key]


def both_ids(texts: list[str], vocabulary: Vocabulary, pieces: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the ids of A (a space and the text) and of B (the text; B adds the space itself)."""
    a, special, _, b, _ = _model(vocabulary, pieces)
    spaced = [f" {t}" for t in texts]
    of_b = b.encode(texts, num_threads=1)
    for text, ids, other in zip(spaced, token_ids(pa.array(spaced, pa.string()), vocabulary), of_b, strict=True):
        if any(s in text for s in special):
            ids = np.array(a.encode(text, add_special_tokens=False).ids)
        yield ids.astype(np.int64), np.array(other, np.int64)


def aligned(text: str, ids_a: np.ndarray, ids_b: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray, str] | None:
    """(id of A, id of B) of the links, in order, and the groups as text; None where the tokens of A or B
    don't spell a space and the text.

    A link is a token of A and one of B that end at the same byte. Every entry has at least a byte, so
    at each such place there is one link, and it closes a group."""
    _, _, (bytes_a, sizes_a, names_a), _, (bytes_b, sizes_b, names_b) = model
    raw = f" {text}".encode()
    for ids, entries in ((ids_a, bytes_a), (ids_b, bytes_b)):
        if b"".join(map(entries.__getitem__, ids.tolist())) != raw:
            return None
    ends_a, ends_b = np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b])
    _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    # Places in the text of groups: A's tokens of a group, then B's.
    before_b = np.append(0, last_b[:-1] + 1)
    before_a = np.append(0, last_a[:-1] + 1)
    at_a = np.arange(len(ids_a)) + np.repeat(before_b, last_a + 1 - before_a)
    at_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, last_b + 1 - before_b)
    words = np.empty(len(ids_a) + len(ids_b), object)
    words[at_a] = list(map(names_a[0].__getitem__, ids_a.tolist()))
    words[at_b] = list(map(names_b[0].__getitem__, ids_b.tolist()))
    words[at_a[last_a]] = list(map(names_a[1].__getitem__, ids_a[last_a].tolist()))
    words[at_b[last_b]] = list(map(names_b[2].__getitem__, ids_b[last_b].tolist()))
    return ids_a[last_a], ids_b[last_b], "".join(words.tolist())[:-1]


_SLICE = "slice string, texts binary, pairs array<bigint>, weights array<bigint>"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) for x in batch.column(0).to_pylist()])
    first = 0
    while first < len(sizes):
        upto = np.cumsum(sizes[first:])
        end = first + max(1, int(np.searchsorted(upto, SLICE_BYTES, "right")))
        yield batch.slice(first, end - first)
        first = end


def sliced(distinct: DataFrame, vocabulary: Vocabulary, pieces: str) -> DataFrame:
    """One row per slice of `distinct` (text, key, weight): its name, its texts' measures as an Arrow table,
    its distinct pairs and how many links hold each, weighted."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        model = _model(vocabulary, pieces)
        for part in (s for batch in batches for s in _slices(batch)):
            texts, weights = part.column(0).to_pylist(), part.column(2).to_numpy()
            rows, links, link_rows = [], [], []
            for row, (text, (ids_a, ids_b)) in enumerate(zip(texts, both_ids(texts, vocabulary, pieces), strict=True)):
                found = aligned(text, ids_a, ids_b, model)
                if found is None:
                    rows.append((0, 0, 0, ""))
                    continue
                link_a, link_b, groups = found
                rows.append((len(ids_a), len(ids_b), len(link_a), hashlib.sha256(groups.encode()).hexdigest()))
                links.append(link_a * _B + link_b)
                link_rows.append(np.full(len(link_a), row))
            every = np.concatenate([np.zeros(0, np.int64), *links])
            owner = np.concatenate([np.zeros(0, np.int64), *link_rows])
            pairs, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weights[owner], len(pairs)).astype(np.int64)
            # A text's pairs with their numbers, as places in `pairs`.
            held, times = np.unique(owner * max(1, len(pairs)) + back, return_counts=True)
            held_row, held_pair = held // max(1, len(pairs)), held % max(1, len(pairs))
            edges = np.searchsorted(held_row, np.arange(len(texts) + 1))
            table = pa.table(
                {
                    "key": part.column(1),
                    **{k: pa.array([r[i] for r in rows]) for i, k in enumerate(("n_a", "n_b", "n_groups", "groups_sha256"))},
                    "pairs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(held_pair, pa.int32())),
                    "times": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times, pa.int32())),
                }
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            name = f"{task}-{number}"
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pairs]), pa.array([counts])],
                ["slice", "texts", "pairs", "weights"],
            )

    return distinct.select("text", "key", "weight").mapInArrow(measured, _SLICE)


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, count (links over all texts that hold it), best (no pair with the same id of B has more)."""
    counts = slices.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    counts = counts.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count"))
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(id_b.alias("id_b")).agg(F.max("count").alias("most"))
    return counts.withColumn("id_b", id_b).join(most, "id_b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _finished(slices: DataFrame, counts: DataFrame) -> DataFrame:
    """key and measures of every distinct text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                with pa.ipc.open_stream(batch.column(0)[row].as_py()) as stream:
                    table = stream.read_all().combine_chunks()
                known = batch.column(1)[row].values
                place = known.field(0).to_numpy()
                number, best = np.zeros((2, len(place)), np.int64)
                number[place] = known.field(1).to_numpy()
                best[place] = known.field(2).to_numpy(zero_copy_only=False)
                lists = table.column("pairs").combine_chunks()
                held, times = lists.flatten().to_numpy(), table.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                n_links, n_best, count_sum = np.zeros((3, len(lists)), np.int64)
                for total, value in ((n_links, times), (n_best, times * best[held]), (count_sum, times * number[held])):
                    np.add.at(total, owner, value)
                plain = [table.column(k).combine_chunks() for k in ("key", "n_a", "n_b", "n_groups")]
                found = [*plain, *map(pa.array, (n_links, n_best, count_sum)), table.column("groups_sha256").combine_chunks()]
                yield pa.RecordBatch.from_arrays(found, ["key", *MEASURES])

    each = slices.select("slice", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    each = each.groupBy("slice").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    none = F.array().cast("array<struct<place:int,count:bigint,best:boolean>>")
    joined = slices.select("slice", "texts").join(each, "slice", "left")
    joined = joined.select("texts", F.coalesce("known", none).alias("known"))
    sizes = ", ".join(f"{k} bigint" for k in MEASURES[:-1])
    return joined.mapInArrow(counted, f"key binary, {sizes}, groups_sha256 string")


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignments(documents: DataFrame, vocabulary: Vocabulary, pieces: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id and measures of every row of `documents`, id pairs with their counts).

    The first: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row in,
    repeated rows and null ids included. Null and empty texts, and texts that A's or B's tokens don't spell,
    have zeros and ''. The second: id_a, id_b, count, best. Further columns of `documents` are ignored;
    an empty table gives none of either.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = documents.filter("text != ''").groupBy("text").agg(F.count("*").alias("weight"))
    slices = cut(sliced(texts.select("text", digest.alias("key"), "weight"), vocabulary, pieces))
    counts = written(pair_counts(slices), "pair-counts")
    found = written(_finished(slices, counts), "aligned-texts")
    rows = documents.select("doc_id", F.when(F.col("text") != "", digest).alias("key"))
    empty = [F.coalesce(F.col(k), F.lit("" if k == "groups_sha256" else 0)).alias(k) for k in MEASURES]
    ids = [F.shiftright("pair", 32).alias("id_a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b")]
    return rows.join(found, "key", "left").select("doc_id", *empty), counts.select(*ids, "count", "best")
