"""Toxicity: a linear classifier that is penalised where exchanging identity terms moves its score.

Features are the distinct words of a text (A-Z lower-cased, punctuation at the ends removed) and
their beginnings, so that inflected forms share one. Learnt are logistic weights of the features
that tell the labels apart best. Training texts that mention a group are also seen with another
group of the same kind in its place; the squared difference of the two scores is part of the
loss, so that mentioning one group rather than another doesn't decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm import textbytes
from comarca.llm.lineage import written

#: Lengths in bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Terms that can stand for each other in a neutral sentence; the next one takes a term's place.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "hispanic", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("old", "young"), ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros"),
)

_OUTER = np.zeros(256, bool)
_OUTER[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_WORD = np.uint64(0x5851F42D4C957F2D)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of all words, whole and as beginnings."""
    hasher = textbytes.Hasher(data)
    out_rows, out = [rows], [textbytes.mix(hasher.of(starts, ends) ^ _WORD)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        out_rows.append(rows[longer])
        out.append(hasher.of(starts[longer], starts[longer] + size))
    return np.concatenate(out_rows), np.concatenate(out)


def _trimmed_words(data, offsets):
    """Words without punctuation at their ends; of a word of nothing but punctuation its last character."""
    starts, ends, rows = textbytes.words(data, offsets)
    if len(starts):
        inner, place = ~_OUTER[data], np.arange(len(data))
        # The next and the last position of a character that is no punctuation.
        on = np.minimum.accumulate(np.where(inner, place, len(data))[::-1])[::-1]
        back = np.maximum.accumulate(np.where(inner, place, -1))
        starts = np.minimum(on[starts], ends - 1)
        ends = np.maximum(back[ends - 1], starts) + 1
    return starts, ends, rows


def _of_text(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return _features(data, np.array([0]), np.array([len(data)]), np.array([0]))[1]


def _swaps() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For the hash of each identity term its features and those of its stand-in."""
    found = {}
    for kind in IDENTITY_TERMS:
        for term, other in zip(kind, (*kind[1:], kind[0]), strict=True):
            found[textbytes.span_hash(term.encode())] = _of_text(term), _of_text(other)
    return found


def text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(first, end, rows, features, words) for each slice; rows and features are distinct pairs only
    after `distinct`."""
    for first, end, data, offsets in textbytes.text_slices(texts):
        data = textbytes.LOWER[data]
        starts, ends, rows = _trimmed_words(data, offsets)
        if len(starts):
            yield first, end, *_features(data, starts, ends, rows), (data, starts, ends, rows)


def distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    return rows[keep], features[keep]


@dataclass
class Model:
    """Feature hashes in order, their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        if len(self.features):
            table = textbytes.HashTable(self.features)
            for first, end, rows, features, _ in text_features(texts):
                at = table.find(features)
                hit = at >= 0
                row, at = distinct(rows[hit], at[hit])
                total[first:end] += np.bincount(row, self.weights[at], end - first)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _drawn(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of `n` rows, drawn by a hash of doc_id (all where there are fewer)."""
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) < most / n * (1 << 20))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, n, n_toxic: training texts that have the feature."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            for first, _, rows, features, _ in text_features(batch.column(0)):
                row, feature = distinct(rows, features)
                key, back = np.unique(feature, return_inverse=True)
                n = np.bincount(back)
                bad = np.bincount(back, toxic[first + row], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(n), pa.array(bad)], ["feature", "n", "n_toxic"]
                )

    found = sample.select("text", "toxic").mapInArrow(counted, "feature bigint, n bigint, n_toxic bigint")
    return found.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _chosen(counts: DataFrame, texts: int, toxic: int, features: int, least: int) -> np.ndarray:
    """The features whose presence tells the labels apart best (by the chi-square statistic)."""
    n, a = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    difference = a * (texts - toxic) - (n - a) * toxic
    chi = texts * difference * difference / (n * (texts - n) * toxic * (texts - toxic))
    best = counts.filter((n >= least) & (n < texts)).withColumn("chi", chi).filter("chi > 4")
    rows = best.orderBy(F.desc("chi"), "feature").limit(features).select("feature").collect()
    return np.array([r["feature"] for r in rows], np.int64).view(np.uint64)


def _training_rows(sample: DataFrame, chosen: np.ndarray) -> pa.Table:
    """toxic, indexes of the text's features, and those of the text with identity terms exchanged
    (null where it mentions none). In Arrow's columns they take a tenth of the memory of rows."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, swaps = textbytes.HashTable(chosen), _swaps()
        terms = np.array(sorted(swaps), np.uint64)
        for batch in batches:
            have: list[set[int]] = [set() for _ in range(batch.num_rows)]
            other: list[list[int] | None] = [None] * batch.num_rows
            for first, _, rows, features, (data, starts, ends, of) in text_features(batch.column(0)):
                at = table.find(features)
                for row, k in zip(rows[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                    have[first + row].add(k)
                word = textbytes.Hasher(data).of(starts, ends)
                hit = np.isin(word, terms)
                for row in set(of[hit].tolist()):
                    mine = set(word[hit & (of == row)].tolist())
                    out = set(have[first + row])
                    for term in mine:
                        out -= set(table.find(swaps[term][0]).tolist())
                    for term in mine:
                        out |= set(table.find(swaps[term][1]).tolist())
                    other[first + row] = sorted(out - {-1})
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([sorted(x) for x in have], pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                ["toxic", "features", "swapped"],
            )

    return sample.select("text", "toxic").mapInArrow(indexed, "toxic int, features array<int>, swapped array<int>").toArrow()


def _sparse(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all elements of a column without nulls."""
    lengths = pc.list_value_length(lists).to_numpy()
    return np.repeat(np.arange(len(lists)), lengths), pc.list_flatten(lists).to_numpy().astype(np.int64)


def _descend(rows: pa.Table, size: int, ridge: float, fairness: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the whole (bounded) training set."""
    y = rows["toxic"].to_numpy().astype(float)
    row, col = _sparse(rows["features"])
    pairs = rows.filter(pc.is_valid(rows["swapped"]))
    left, left_col = _sparse(pairs["features"])
    right, right_col = _sparse(pairs["swapped"])
    n, m = len(rows), len(pairs)
    step = np.ones(size)
    weights, intercept = np.zeros(size), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    mean, square, mean0, square0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[col], n) + intercept)))
        error = (p - y) / n
        gradient = np.bincount(col, error[row], size) + ridge * weights
        if m:
            gap = np.bincount(left, weights[left_col], m) - np.bincount(right, weights[right_col], m)
            pull = 2 * fairness * gap / m
            gradient += np.bincount(left_col, pull[left], size) - np.bincount(right_col, pull[right], size)
        g0 = error.sum()
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        mean0, square0 = 0.9 * mean0 + 0.1 * g0, 0.999 * square0 + 0.001 * g0**2
        rate = 0.1 / np.sqrt(1 + k / 50)
        weights = weights - step * rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-10)
        intercept -= rate * (mean0 / (1 - 0.9**k)) / (np.sqrt(square0 / (1 - 0.999**k)) + 1e-10)
    return weights, intercept


def fit(
    labelled: DataFrame,
    most_texts: int = 20_000,
    features: int = 4096,
    least: int = 4,
    ridge: float = 3e-5,
    fairness: float = 1.0,
    rounds: int = 300,
) -> Model:
    """Learns from `labelled` (doc_id, text, toxic 0/1); rows without a label or text are left out.

    At most about `most_texts` rows are learnt from, drawn by a hash of doc_id. Counting features is
    a Spark aggregation; what the driver receives is bounded by `most_texts` and `features`. With no
    rows, or one class only, the model has no features and gives everywhere the share of toxic
    texts (0 without rows).
    """
    rows = labelled.filter("text is not null and toxic in (0, 1)")
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    size = [F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))]
    texts, toxic = rows.agg(*size).first()
    sample = _drawn(rows, texts, most_texts)
    if texts > most_texts:
        texts, toxic = sample.agg(*size).first()
    none = np.zeros(0, np.uint64)
    if not texts or toxic in (0, texts):
        return Model(none, np.zeros(0), 20.0 if texts and toxic else -20.0)
    chosen = _chosen(_feature_counts(sample), texts, toxic, features, least)
    rows = _training_rows(sample, chosen)
    weights, intercept = _descend(rows, len(chosen), ridge, fairness, rounds)
    return Model(chosen, weights, intercept)


def scored(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of `documents` with `score` (0 to 1) and `predicted` (1 from 0.5 up).

    Every row comes back; null and empty texts get the score of a text without features."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(0)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*names, "score"])

    text = F.col("text").alias("_text")
    found = documents.select(text, *names).mapInArrow(run, f"{schema}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_rows(documents: DataFrame, labels: DataFrame, most_texts: int = 20_000) -> DataFrame:
    """doc_id, text, toxic of documents with one label; ids with contradicting labels have none.

    Where more than `most_texts` documents have a label, about so many of the labelled ids are drawn
    by the hash that `fit` draws with. The ids are drawn before they meet a text, counted, and sent
    to the texts if there are at most twice as many as wanted; else (labels of ids that no document
    has) both sides are shuffled.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).filter("toxic = _other").drop("_other")
    known = written(known, "labels")
    n = documents.select("doc_id").join(known, "doc_id").count()
    drawn = _drawn(known, n, most_texts)
    if drawn.count() <= 2 * most_texts:
        drawn = F.broadcast(drawn)
    return documents.select("doc_id", "text").join(drawn, "doc_id")
