"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public (all pieces of a sentencepiece model, and every single byte). A
language is a probability for each piece. The likelihood of a word is the sum over all its
segmentations into pieces, by the forward algorithm in logarithms; a text's is the product over
its words. Piece probabilities come from expectation maximisation, whose expected counts run the
same recursion forwards and backwards.

Words may be of any length. Where no piece of a word spans a place, every segmentation has a
boundary there, so the recursion starts anew and the sums are added: equal results, fewer steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm import textbytes
from comarca.llm.lineage import cut

#: Bytes of words whose matches are held at once (or one longer word).
HELD_BYTES = 1 << 16
#: Distinct words whose scores a worker remembers; it starts anew beyond (bounds memory only).
REMEMBERED = 300_000
#: Tasks that share the expected counts of the (bounded) training words.
TASKS = 24
#: Added to every expected count, so that no piece is impossible in any language.
SMOOTHING = 0.05


def vocabulary(path: str) -> list[bytes]:
    """Pieces as bytes: a space for the space mark, then all single bytes not among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.append(model.id_to_piece(i).replace("▁", " ").encode())
    pieces = [p for p in dict.fromkeys(pieces) if p]
    have = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in have]


@dataclass
class Model:
    """Languages in order and their piece probabilities; the last row is for what is no piece."""

    languages: list[str]
    pieces: list[bytes]
    probability: np.ndarray

    def __post_init__(self) -> None:
        prefixes = {p[:n]: -1 for p in self.pieces for n in range(1, len(p))}
        prefixes.update({p: i for i, p in enumerate(self.pieces)})
        sizes = np.array([len(p) for p in prefixes])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(prefixes), np.uint8)
        #: Every prefix of a piece, and the index of the piece that it is (-1: none).
        self.table = textbytes.HashTable(textbytes.Hasher(data).of(ends - sizes, ends))
        self.piece = np.array(list(prefixes.values()))
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.probability)
        self.known: dict[int, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def __reduce__(self) -> tuple:
        digest = hashlib.blake2b(self.probability.tobytes(), digest_size=16).hexdigest()
        return _restored, (digest, self.languages, self.pieces, self.probability)


_latest: dict[str, Model] = {}


def _restored(digest: str, languages: list[str], pieces: list[bytes], probability: np.ndarray) -> Model:
    """The model in a worker, which keeps the last one with the words that it has scored."""
    if digest not in _latest:
        _latest.clear()
        _latest[digest] = Model(languages, pieces, probability)
    return _latest[digest]


@dataclass
class _Lattice:
    """All places of pieces in some words, as edges between places.

    Words fall into segments at places that no piece spans. A segment of n bytes has n + 1 places,
    numbered on over all segments. Edges are ordered by where they begin within their segment, so that
    those of one step (`steps`: ranges of edges) lead to places of their own."""

    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    steps: list[tuple[int, int]]
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray
    segment: np.ndarray


def _lattice(model: Model, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> _Lattice:
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    flat = data[np.repeat(starts - (upto - sizes), sizes) + np.arange(total)]
    limit = np.repeat(upto, sizes)
    hasher = textbytes.Hasher(flat)
    at, size, found = np.arange(total), 0, []
    while len(at):
        size += 1
        prefix = model.table.find(hasher.of(at, at + size))
        at, piece = at[prefix >= 0], model.piece[prefix[prefix >= 0]]
        hit = piece >= 0
        found.append((at[hit], np.full(int(hit.sum()), size), piece[hit]))
        at = at[at + size < limit[at]]
    begin, size, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    spanned = np.cumsum(np.bincount(begin + 1, minlength=total + 2) - np.bincount(begin + size, minlength=total + 2))
    opens = spanned[:total] == 0
    opens[upto - sizes] = True
    segment = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    within = begin - first[segment[begin]]
    order = np.argsort(within, kind="stable")
    within, begin, size, piece = within[order], begin[order], size[order], piece[order]
    marks = np.flatnonzero(np.diff(within, prepend=-1))
    steps = list(zip(marks.tolist(), [*marks[1:].tolist(), len(within)], strict=True))
    place = begin + segment[begin]
    each = np.arange(len(first))
    last = np.append(first[1:], total) + each
    return _Lattice(place, place + size, piece, steps, first + each, last, np.repeat(np.arange(len(sizes)), sizes)[first], segment[begin])


def _forward(lattice: _Lattice, logs: np.ndarray) -> np.ndarray:
    """For each place the logarithm of the sum over all ways from its segment's first place; `logs` per edge."""
    alpha = np.full((int(lattice.last[-1]) + 1 if len(lattice.last) else 0, *logs.shape[1:]), -np.inf)
    alpha[lattice.first] = 0.0
    for a, b in lattice.steps:
        end = lattice.end[a:b]
        alpha[end] = np.logaddexp(alpha[end], alpha[lattice.begin[a:b]] + logs[a:b])
    return alpha


def _backward(lattice: _Lattice, logs: np.ndarray) -> np.ndarray:
    """The same to the segment's last place."""
    beta = np.full(int(lattice.last[-1]) + 1, -np.inf)
    beta[lattice.last] = 0.0
    for a, b in reversed(lattice.steps):
        # Edges of a step are ordered by size, those of one size begin at places of their own.
        size = lattice.end[a:b] - lattice.begin[a:b]
        marks = np.flatnonzero(np.diff(size, prepend=0)).tolist()
        for c, d in zip(marks, [*marks[1:], b - a], strict=True):
            begin, end = lattice.begin[a + c : a + d], lattice.end[a + c : a + d]
            beta[begin] = np.logaddexp(beta[begin], beta[end] + logs[a + c : a + d])
    return beta


def _held(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of words of about `HELD_BYTES` in all, each of at least one word."""
    for first, end in textbytes.slices(np.concatenate([[0], np.cumsum(sizes)]), HELD_BYTES):
        yield slice(first, end)


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language: the forward sums over all segmentations."""
    out = np.zeros((len(starts), len(model.languages)))
    for held in _held(sizes):
        lattice = _lattice(model, data, starts[held], sizes[held])
        ends = _forward(lattice, model.logs[lattice.piece])[lattice.last]
        for k in range(out.shape[1]):
            out[held, k] = np.bincount(lattice.word, ends[:, k], len(out[held]))
    return out


def expected_counts(model: Model, data, starts, sizes, language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language; a word occurs `times` in its `language`."""
    counts = np.zeros_like(model.probability)
    for held in _held(sizes):
        lattice = _lattice(model, data, starts[held], sizes[held])
        of = language[held][lattice.word][lattice.segment]
        logs = model.logs[lattice.piece, of]
        alpha, beta = _forward(lattice, logs), _backward(lattice, logs)
        whole = alpha[lattice.last][lattice.segment]
        used = np.exp(alpha[lattice.begin] + logs + beta[lattice.end] - whole) * times[held][lattice.word][lattice.segment]
        counts += np.bincount(lattice.piece * counts.shape[1] + of, used, counts.size).reshape(counts.shape)
    return counts


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before each word, and starts, sizes and rows of the words with it.

    White space counts as one space before a word; letters are lower-cased where ASCII."""
    starts, ends, rows = textbytes.words(data, offsets)
    lengths = ends - starts + 1
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    source = np.repeat(starts - 1 - (upto - lengths), lengths) + np.arange(total)
    spaced = textbytes.LOWER[data[np.maximum(source, 0)]] if total else np.zeros(0, np.uint8)
    begin = upto - lengths
    spaced[begin] = 32
    return spaced, begin, lengths, rows


def text_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Log likelihood of each text in each language; 0 for texts without a word."""
    total = np.zeros((len(texts), len(model.languages)))
    for first, end, data, offsets in textbytes.text_slices(texts):
        spaced, starts, sizes, rows = words_of(data, offsets)
        if not len(starts):
            continue
        keys = textbytes.Hasher(spaced).of(starts, starts + sizes)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        found = list(map(model.known.get, names))
        missing = [i for i, at in enumerate(found) if at is None]
        if missing:
            at = where[missing]
            fresh = word_scores(model, spaced, starts[at], sizes[at])
            if len(model.known) + len(missing) > REMEMBERED:
                old = [i for i, x in enumerate(found) if x is not None]
                model.scores, kept = model.scores[[found[i] for i in old]], [names[i] for i in old]
                model.known = dict(zip(kept, range(len(kept)), strict=True))
                for n, i in enumerate(old):
                    found[i] = n
            base = len(model.scores)
            model.scores = np.concatenate([model.scores, fresh])
            for n, i in enumerate(missing):
                found[i] = model.known[names[i]] = base + n
        scores = model.scores[np.array(found)]
        for k in range(total.shape[1]):
            total[first:end, k] = np.bincount(rows, scores[:, k][back], end - first)
    return total


def fit(rows: DataFrame, path: str, rounds: int = 3, texts_per_language: int = 1000) -> Model | None:
    """Piece probabilities of every language of `rows` (doc_id, text, lang).

    Of each language about `texts_per_language` texts are learnt from, drawn by a hash of doc_id
    (all where there are fewer). Expected counts are computed in parallel over the distinct
    words; the driver receives one number per piece and language. None if there is no text.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    languages = sorted(per)
    share = F.element_at(
        F.create_map(*[F.lit(x) for k in languages for x in (k, texts_per_language / per[k])]), F.col("lang")
    )
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)
    sample = rows.filter(drawn | (share >= 1)).select("lang", "text")
    if not sample.head(1):
        sample = rows.select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, end, data, offsets in textbytes.text_slices(batch.column(1)):
                spaced, starts, sizes, at = words_of(data, offsets)
                if not len(starts):
                    continue
                keys = textbytes.Hasher(spaced).of(starts, starts + sizes)
                pair = textbytes.mix(keys + of[first:end][at].astype(np.uint64))
                _, where, n = np.unique(pair, return_index=True, return_counts=True)
                raw = spaced.tobytes()
                word = [raw[a : a + s] for a, s in zip(starts[where], sizes[where], strict=True)]
                language = of[first:end][at[where]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language), pa.array(word, pa.binary()), pa.array(n)], ["language", "word", "n"]
                )

    counts = sample.mapInArrow(counted, "language int, word binary, n bigint")
    counts = counts.groupBy("language", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts.repartition(TASKS, "word"))
    pieces = vocabulary(path)
    size, kinds = len(pieces) + 1, len(languages)
    model = Model(languages, pieces, np.full((size, kinds), 1.0 / size))
    for _ in range(rounds):
        model = Model(languages, pieces, _maximised(counts, model))
    return model


def _maximised(counts: DataFrame, model: Model) -> np.ndarray:
    """Probabilities after one round of expectation maximisation."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(model.probability)
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                part = batch.slice(first, 20_000)
                data, offsets = textbytes.text_column(part.column(1).cast(pa.large_binary()).view(pa.large_string()))
                language, times = part.column(0).to_numpy(), part.column(2).to_numpy()
                total += expected_counts(model, data, offsets[:-1], np.diff(offsets), language, times)
        for k in range(total.shape[1]):
            used = np.flatnonzero(total[:, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[used, k])],
                ["language", "piece", "n"],
            )

    found = counts.mapInArrow(expected, "language int, piece int, n double")
    sums = found.groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
    new = np.full_like(model.probability, SMOOTHING)
    new[sums["piece"], sums["language"]] += sums["n"]
    new[-1] = 0
    return new / new.sum(axis=0)


def identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """`lang_pred` and `score` for each row of `documents` (doc_id, text).

    The score is the posterior of the best language, all languages being equally likely before;
    ties go to the smaller name. Null texts and texts without a letter give `und` and 0, and so
    does every text where there is no model. All rows come back, repeated ones and null ids too.
    """
    kind = dict(documents.dtypes)["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            name, score = np.full(n, "und", object), np.zeros(n)
            if model is not None and n:
                logs = text_scores(model, batch.column(1))
                best = logs.argmax(axis=1)
                posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                has = batch.column(2).to_numpy(zero_copy_only=False)
                name = np.where(has, np.array(model.languages, object)[best], "und")
                score = np.where(has, posterior, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return documents.select("doc_id", "text", letters).mapInArrow(
        scored, f"doc_id {kind}, lang_pred string, score double"
    )
