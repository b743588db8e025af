"""Best-fit packing of tokenised documents into sequences by bin completion.

1. Every document is tokenised in the task that reads it. Pieces (where they lie, how long
   they are, the checksum of their ids) are written once to the shared checkpoint folder.
2. The packing is decided on the histogram of piece lengths, at most `capacity` numbers at any
   input size: `pack_lengths` below.
3. Pieces of one length are interchangeable, so the plan gives places to ranks within a length.
   Ranks are computed in parts: lengths are split into chunks by a hash, chunks are counted,
   and a rank is the chunk's offset plus the place in the chunk. No task holds a whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm import textbytes
from comarca.llm.lineage import cut

#: Bytes of the distinct chunks whose ids a worker remembers; it starts anew beyond (bounds memory only). Looking
#: a slice's chunks up takes time for all that are remembered, so more of them don't save time.
REMEMBERED = 1 << 21
#: Bytes of a slice: larger ones look up fewer distinct chunks in all.
SLICE_BYTES = 1 << 22
#: White space beyond ASCII, which the tokenizer's pattern joins with white space around it.
OTHER_WHITE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: For each vocabulary the remembered chunks, their ids one behind the other, and the number of ids of each.
_known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray] | None] = {}
_models: dict[str, tuple] = {}


@dataclass(frozen=True)
class Vocabulary:
    """One byte-level vocabulary in two files: `whole` for tokenizers, `ranks` for tiktoken, which
    is three times as fast on short strings; `pattern` splits a text before the merges."""

    whole: str
    ranks: str
    pattern: str


# --- tokenising -------------------------------------------------------------------------------


def _model(vocabulary: Vocabulary) -> tuple:
    """The tokenizer, its twin for chunks, the pattern of texts that the former must see whole, and the
    number of bytes of each id."""
    if vocabulary.whole not in _models:
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary.whole)
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        twin = tiktoken.Encoding("chunks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t.content) for t in model.get_added_tokens_decoder().values()]
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        widths[list(ranks.values())] = [len(x) for x in ranks]
        _models[vocabulary.whole] = model, twin.encode_ordinary, "|".join([OTHER_WHITE, *special]), widths
    return _models[vocabulary.whole]


def _bytes_of(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large binary column without nulls and the offsets of its rows."""
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _encoded(names: pa.Array, encode, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks (a large binary column), one behind the other, and the number of ids of each.

    Chunks of a space and a word are encoded as one text, which takes less than half the time: each
    begins with the space of its own, so the pattern parts them as the chunks are. Their ids are told apart
    by the bytes they stand for. Should an end not fall on the end of an id (only invalid UTF-8, or other
    white space in texts that are encoded whole), each chunk is encoded alone, like all other chunks."""
    counts = np.zeros(len(names), np.int64)
    if not len(names):
        return np.zeros(0, "<u4"), counts
    data, offsets = _bytes_of(names)
    spaced = np.diff(offsets) > 1
    begins = offsets[:-1][spaced]
    spaced[spaced] = (data[begins] == 32) & ~textbytes.WHITE[data[begins + 1]]
    ids = np.zeros(0, "<u4")
    if spaced.any():
        text, offsets = _bytes_of(names.filter(pa.array(spaced)))
        ids, ends = np.array(encode(text.tobytes().decode("utf-8", "replace")), "<u4"), offsets[1:]
        upto = np.cumsum(widths[ids])
        last = np.searchsorted(upto, ends)
        if upto[-1] == ends[-1] and (upto[last] == ends).all():
            counts[spaced] = np.diff(last, prepend=-1)
        else:
            spaced[:], ids = False, ids[:0]
    alone = [encode(x.decode("utf-8", "replace")) for x in names.filter(pa.array(~spaced)).to_pylist()]
    counts[~spaced] = list(map(len, alone))
    flat, together = np.empty(counts.sum(), "<u4"), np.repeat(spaced, counts)
    flat[together] = ids
    flat[~together] = np.fromiter(chain.from_iterable(alone), "<u4")
    return flat, counts


def _chunk_ids(names: list[bytes], encode, widths: np.ndarray) -> list[bytes]:
    """`_encoded` for a list: the ids of each chunk."""
    flat, counts = _encoded(pa.array(names, pa.large_binary()), encode, widths)
    return [flat[end - n : end].tobytes() for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)]


def _looked_up(names: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins, counts): the ids of distinct chunks are `counts` many from `begins` on; those of
    chunks that the worker remembers are not encoded again."""
    _, encode, _, widths = _model(vocabulary)
    known, ids, counts = _known.get(vocabulary.whole) or (names[:0], np.zeros(0, "<u4"), np.zeros(0, np.int64))
    place = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy().astype(np.int64)
    missing = place < 0
    new = names.filter(pa.array(missing))
    new_ids, new_counts = _encoded(new, encode, widths)
    place[missing] = len(known) + np.arange(len(new))
    both = pa.concat_arrays([known, new])
    ids, counts = np.concatenate([ids, new_ids]), np.concatenate([counts, new_counts])
    kept = [(both, ids, counts), (new, new_ids, new_counts), None]
    _known[vocabulary.whole] = next(x for x in kept if x is None or len(_bytes_of(x[0])[0]) <= REMEMBERED)
    return ids, (np.cumsum(counts) - counts)[place], counts[place]


def token_ids(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Ids (little-endian unsigned 32 bit) of each text in order; null counts as empty.

    The pattern of the tokenizer never joins a word with anything before the one white-space
    character in front of it, so a text is encoded chunk by chunk, each distinct chunk once.
    Texts with other white space or with special strings are encoded whole.
    """
    model, _, odd, _ = _model(vocabulary)
    whole = pc.fill_null(pc.match_substring_regex(texts, odd), False).to_numpy(zero_copy_only=False)
    for first, end, data, offsets in textbytes.text_slices(texts, SLICE_BYTES):
        rows_here = end - first
        if not len(data):
            yield from (np.zeros(0, "<u4") for _ in range(rows_here))
            continue
        starts, _, rows = textbytes.chunks(data, offsets)
        # Chunks cover the slice gaplessly, so their starts are the offsets of a column.
        ends = pa.py_buffer(np.append(starts, len(data)))
        distinct = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        back = distinct.indices.to_numpy()
        flat, begins, sizes = _looked_up(distinct.dictionary, vocabulary)
        each = sizes[back]
        upto = np.cumsum(each)
        place = np.repeat(begins[back] - (upto - each), each) + np.arange(upto[-1])
        out = flat[place]
        edge = np.append(0, np.cumsum(np.bincount(rows, each, rows_here).astype(np.int64)))
        for row in range(rows_here):
            if whole[first + row]:
                text = texts[first + row].as_py()
                yield np.array(model.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                yield out[edge[row] : edge[row + 1]]


def pieces(documents: DataFrame, vocabulary: Vocabulary, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and then id 0, cut only where
    longer than `capacity`; the first piece is the shorter one."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(token_ids(batch.column(1), vocabulary)):
                raw = ids.tobytes() + b"\0\0\0\0"
                size = len(raw) // 4
                at, k = 0, 0
                while at < size:
                    end = at + ((size - at) % capacity or capacity)
                    of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * end]))
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        cut_up, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# --- packing lengths --------------------------------------------------------------------------


@dataclass
class Packing:
    """How often each pattern (lengths, longest first) is used."""

    used: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.used)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs: total length, sharpened by pieces that do not fit
    together (for each limit k: pieces over capacity - k need a sequence each, those over half
    one each, and what of the pieces from k up to half does not fit beside the latter)."""
    sizes = np.arange(capacity + 1)
    total = np.append(0, np.cumsum(counts * sizes))
    number = np.append(0, np.cumsum(counts))
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for k in range(0, half + 1):
        large = int(number[-1] - number[capacity - k + 1])
        middle = int(number[capacity - k + 1] - number[half + 1])
        room = middle * capacity - int(total[capacity - k + 1] - total[half + 1])
        small = int(total[half + 1] - total[k])
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Best-fit decreasing on a histogram: each length goes where least room is left."""
    open_: dict[int, list[list]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in open_ if r >= size):
            here = open_[room]
            while here and left:
                pattern, n = here.pop()
                fit = min(room // size, -(-left // n)) if n else 0
                take = min(n, left // fit)
                if take < n:
                    here.append([pattern, n - take])
                open_.setdefault(room - fit * size, []).append([(*pattern, *[size] * fit), take])
                left -= fit * take
            if not here:
                open_.pop(room, None)
            if not left:
                break
        if left:
            fit = capacity // size
            full, rest = divmod(left, fit)
            if full:
                open_.setdefault(capacity - fit * size, []).append([(size,) * fit, full])
            if rest:
                open_.setdefault(capacity - rest * size, []).append([(size,) * rest, 1])
    return Packing([(p, n) for group in open_.values() for p, n in group if n])


def fillings(counts: np.ndarray, room: int, least: int, most: int = 64) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`: lengths whose sum is at least `least`, fullest first.

    Depth first, longest lengths first. A filling to which a further piece could be added, or in
    which a length could be exchanged for a longer one still there, is dominated and left out.
    The first `most` found with the least waste are enough for the search below.
    """
    sizes = np.flatnonzero(counts)[::-1]
    sizes = sizes[sizes <= room].tolist()
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = [4096]

    def grow(at: int, left: int, chosen: tuple[int, ...]) -> None:
        if steps[0] <= 0 or len(found) >= most:
            return
        steps[0] -= 1
        fits = False
        for i in range(at, len(sizes)):
            size = sizes[i]
            if size <= left and counts[size] > chosen.count(size):
                fits = True
                grow(i, left - size, (*chosen, size))
                if found and found[-1][0] == 0 and len(found) >= most // 2:
                    return
        if not fits and room - left >= least and not _dominated(counts, chosen, left):
            found.append((left, chosen))

    grow(0, room, ())
    return [chosen for _, chosen in sorted(found)]


def _dominated(counts: np.ndarray, chosen: tuple[int, ...], left: int) -> bool:
    """Whether some chosen length could give way to a longer one that is there and fits."""
    for size in set(chosen):
        longer = counts[size + 1 : size + left + 1]
        own = [chosen.count(s) for s in range(size + 1, size + left + 1)]
        if (longer > np.array(own, longer.dtype)).any() if len(longer) else False:
            return True
    return False


def pack_lengths(counts: np.ndarray, capacity: int, work: int = 150_000) -> Packing:
    """Packs pieces, `counts[s]` of length s each, into few sequences of `capacity`.

    Branch and bound over completions of the largest piece left. A node takes the largest piece
    and an undominated filling of its room, as often as the counts allow at once. Nodes whose
    waste so far exceeds what the incumbent minus one sequence could have are pruned; the
    best-fit packing of what is left at a node is the bound from above and becomes the incumbent
    where it is better. Ends at the lower bound, or with the best found after `work` distinct lengths
    looked at over all nodes: that limits the search for a better packing, never what is packed.
    """
    counts = np.asarray(counts, np.int64).copy()
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    stack: list[tuple[np.ndarray, list, int, int]] = [(counts, [], 0, 0)]
    budget = work
    while stack and best.sequences > bound and budget > 0:
        left, used, bins, waste = stack.pop()
        budget -= 1 + int(np.count_nonzero(left))
        if not left.any():
            if bins < best.sequences:
                best = Packing(used)
            continue
        rest = best_fit(left, capacity)
        if bins + rest.sequences < best.sequences:
            best = Packing(used + rest.used)
        allowed = (best.sequences - 1) * capacity - total
        if waste > allowed or bins + lower_bound(left, capacity) >= best.sequences:
            continue
        largest = int(np.flatnonzero(left)[-1])
        room = capacity - largest
        beside = left.copy()
        beside[largest] -= 1
        options = fillings(beside, room, max(0, room - (allowed - waste)), 8)
        for filling in reversed(options):
            pattern = (largest, *filling)
            times = min(int(left[s]) // pattern.count(s) for s in set(pattern))
            after = left.copy()
            for s in pattern:
                after[s] -= times
            spare = (capacity - sum(pattern)) * times
            stack.append((after, [*used, (pattern, times)], bins + times, waste + spare))
    return best


# --- placing ----------------------------------------------------------------------------------


def places(packing: Packing) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they lie: sorted by length and first rank.

    Bounded by the packing's patterns, which are bounded by the lengths, not by the pieces."""
    length, rank, sequence, offset = [], [], [], []
    upto: dict[int, int] = {}
    base = 0
    for pattern, n in packing.used:
        at = 0
        for size in pattern:
            length.append(size)
            rank.append(upto.get(size, 0))
            sequence.append(base)
            offset.append(at)
            upto[size] = upto.get(size, 0) + n
            at += size
        base += n
    order = np.lexsort((rank, length))
    named = {"length": length, "rank": rank, "sequence": sequence, "offset": offset}
    return {k: np.array(v, np.int64)[order] for k, v in named.items()}


def ranked(rows: DataFrame, size: str, keys: list[str], per_chunk: int) -> DataFrame:
    """`rows` with `rank`, 0-based within `size`, computed chunk by chunk.

    Chunks hold about `per_chunk` rows. Their offsets come from one row per chunk, summed within a
    length. Rows that are equal in all of `keys` are interchangeable.
    """
    number = rows.groupBy(size).agg(F.count("*").alias("_n"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_n") / per_chunk)).cast("long")
    parts = rows.join(number, size).withColumn("_chunk", F.pmod(F.xxhash64(*keys), chunks)).drop("_n")
    offsets = parts.groupBy(size, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(size).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(size, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(size, "_chunk").orderBy(*keys)) - 1
    return (
        parts.withColumn("_within", within)
        .join(offsets, [size, "_chunk"])
        .withColumn("rank", F.col("_before") + F.col("_within"))
        .drop("_chunk", "_within", "_before")
    )


def packed(documents: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, per_chunk: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    `documents` has doc_id and text; a null text is empty and still gives one piece (its id 0).
    Repeated rows and rows without doc_id are packed like any other. An empty table gives no rows.
    Lengths of sequences never exceed `capacity`; offsets are gapless from 0.
    """
    parts = cut(pieces(documents, vocabulary, capacity))
    histogram = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row a length
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = places(pack_lengths(counts, capacity))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    span = int(counts.max()) + 1
    first = plan["length"] * span + plan["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(first, length * span + rank, "right") - 1
            sequence = plan["sequence"][at] + rank - plan["rank"][at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(plan["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(documents.dtypes)["doc_id"]
    found = ranked(parts, "length", keys, per_chunk)
    found = found.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return found.mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
