"""Queries against their SQL, the index against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from comarca.llm import permutation_index, queries, toxicity
from comarca.llm.lineage import shared_folder
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, duck(FOLDER), name, FOLDER, queries.REGISTRY[name], queries.SQL[name]) is None


def test_index_recall_and_scores(spark):
    rows = queries.op5_permutation_index(spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        mine = sorted(found[ids[at]])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        assert [s for _, _, s in mine] == pytest.approx([scores[np.searchsorted(ids, v)] for _, v, _ in mine])
        scores[at] = -9
        hits += len({v for _, v, _ in mine} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(found)


def test_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (10, [1.0]), (None, [1.0, 1.0]), (3, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    found = permutation_index.neighbours(vectors, vectors, nearest=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0), (3, 1, 0, 0.0), (3, 2, 1, 0.0),
    ]
    assert permutation_index.neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_index_with_small_blocks(spark):
    """Several lengths, repeated ids, ids as text, many blocks, a cluster with a third of all rows: exact with all lists read."""
    rng = np.random.default_rng(3)
    rows = [(f"a{k}", rng.normal(size=5 if k % 4 else 3).tolist()) for k in range(1500)]
    rows += [(f"b{k}", [1.0, 0.0, 0.0, 0.0, 1e-9 * (k % 7)]) for k in range(700)] + [("a1", [9.0, 0.0, 0.0, 0.0, 0.0]), ("b1", [1.0, 0.0, 0.0, 0.0, 1e-9])]
    vectors = spark.createDataFrame(rows, "name string, v array<double>").withColumns({"dim": F.lit(1), "at": F.lit("x"), "asked": F.lit(0)})
    chosen = {"a1", "a4", "a8", "b3", "b699"}
    wanted, rows = {}, sorted({(i, tuple(v)) for i, v in rows})
    for own in rows:
        if own[0] in chosen:
            scored = [(-sum(a * b for a, b in zip(own[1], v, strict=True)), i) for i, v in rows if (i, v) != own and len(v) == len(own[1])]
            wanted.setdefault(own[0], []).extend((k + 1, i, pytest.approx(-s)) for k, (s, i) in enumerate(sorted(scored)[:4]))
    keys = {"key": "name", "vector": "v", "nearest": 4, "block_values": 5}
    for queries_ in (F.col("name").isin(*chosen), vectors.filter(F.col("name").isin(*chosen))):
        found = permutation_index.neighbours(vectors, queries_, read=256, examined=1.0, **keys).collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v, key=lambda x: x[:2]) for k, v in wanted.items()}


def test_index_reads_less_than_all(spark):
    """Posting lists hold all rows under their nearest pivots; a query looks at rows in its own lists only."""
    rng = np.random.default_rng(4)
    vectors, points = rng.normal(size=(4000, 64)), rng.normal(size=(256, 64))
    order = np.argsort(-(vectors @ points.T), axis=1, kind="stable")
    rows, starts = permutation_index._lists(order, 256, 16)
    for pivot in (0, 100, 255):
        assert rows[starts[pivot] : starts[pivot + 1]].tolist() == np.flatnonzero((order[:, :16] == pivot).any(axis=1)).tolist()
    block = permutation_index.Block(np.arange(4000), vectors, np.ascontiguousarray(permutation_index._places(order).T), rows, starts)
    for k in range(5):
        found = block.candidates(order[k], 16, 21)
        assert found.tolist() == np.flatnonzero(np.isin(order[:, :16], order[k, :16]).any(axis=1)).tolist() and len(found) < 3000
        near = block.ranked(found, order[k, :64], 1000)
        places = np.argsort(order, axis=1)
        footrule = np.abs(places[:, order[k, :64]] - np.arange(64)).sum(axis=1)
        assert 1000 <= len(near) < 1100 and set(near) == {r for r in found if footrule[r] <= sorted(footrule[found])[999]}


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    kept = dict(corpus_pipeline.STAGES)
    calm = kept["toxicity"](spark, docs, FOLDER).cache()
    model = queries.toxicity_model(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    gone = toxicity.scored(docs, model).filter("predicted = 1")
    assert calm.columns == names and calm.count() == docs.count() - gone.count() and gone.count() > 0
    lines = kept["line_dedup"](spark, calm, FOLDER).cache()
    assert lines.columns == names and lines.filter("n_chars != length(text)").count() == 0
    long = lines.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.regexp_count("line", F.lit("[^ ]+")) > 50)
    assert long.groupBy("line").count().filter("count > 1").count() == 0
    single = kept["jaccard_join"](spark, lines, FOLDER).cache()
    assert single.columns == names and single.count() <= lines.count()
    mix = kept["source_mix"](spark, single, FOLDER).cache()
    assert mix.columns == names
    assert mix.select("doc_id").distinct().join(single, "doc_id", "left_anti").count() == 0
    pieces = kept["packing"](spark, mix, FOLDER)
    assert pieces.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert pieces.filter("piece = 0").count() == mix.count()


def _passage(start, changed=()):
    return " ".join(f"w{i}x" if i in changed else f"w{i}" for i in range(start, start + 120))


def test_pipeline_join_keeps_one_row_per_id_and_text(spark):
    near = _passage(0, {119})
    rows = [
        (1, _passage(0), "en", "a", 9), (1, _passage(0), "en", "a", 9), (1, _passage(0), "de", "b", 9),  # the smallest id, repeated
        (2, near, "en", "a", 9), (2, near, "en", "a", 9),
        (3, _passage(500), "en", "a", 9), (3, _passage(500), "en", "a", 9),
        (4, None, "en", "a", None), (4, None, "en", "a", None),
        (None, _passage(0), "en", "a", 9), (None, _passage(0), "en", "a", 9),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def kept(rows):
        left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), FOLDER)
        return sorted(((r.doc_id or 0, r.text or "", r.lang) for r in left.collect()))

    expected = [(0, _passage(0), "en")] * 2 + [(1, _passage(0), "de"), (3, _passage(500), "en"), (4, "", "en")]
    assert kept(rows) == expected
    # An id with two texts: only the near copy goes.
    more = [(5, near, "en", "a", 9), (5, _passage(900), "en", "a", 9), (5, _passage(900), "en", "a", 9), (6, _passage(900, {900}), "en", "a", 9)]
    assert kept(rows + more) == [*expected, (5, _passage(900), "en")]
    # Two near copies under one id: one of them stays.
    both = kept([(7, _passage(0), "en", "a", 9), (7, near, "en", "a", 9), (8, _passage(0), "en", "a", 9)])
    assert len(both) == 1 and both[0][0] == 7
    assert kept([]) == []


def _plain_lines(rows, min_lines=3, min_words=25):
    """Texts without lines in a run that an earlier place has, by (id, text); None where no line is left."""
    texts = sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None})
    worded = {t: [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(t[1].split("\n")) if x.split()] for t in texts}
    seen, gone = set(), defaultdict(set)
    for t in texts:
        for i in range(len(worded[t])):
            for j in range(i + 1, len(worded[t]) + 1):
                run = tuple(x for _, x in worded[t][i:j])
                if j - i >= min_lines or sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[t] |= {k for k, _ in worded[t][i:j]}
                    seen.add(run)
    left = {}
    for t in texts:
        whole = gone[t] and len(gone[t]) == len(worded[t])
        left[t] = None if whole else "\n".join(x for k, x in enumerate(t[1].split("\n")) if k not in gone[t])
    return [(r[0], left.get(r[:2], r[1]), *r[2:]) for r in rows if r[:2] not in left or left[r[:2]] is not None]


def _plain_join(rows):
    """One row per id and text; of texts linked at 0.8 over five-word shingles the smallest id."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    nodes = sorted({r[:2] for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets, root = {n: shingles(n[1]) for n in nodes}, {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            both = len(sets[a] & sets[b])
            if a != b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    kept = [min(r for r in rows if r[:2] == n) for n in nodes if root[n] == n]
    return kept + [r for r in rows if r[0] is None]


def _plain_mix(rows, weights=(5, 2, 1), most=3):
    """How often each row is taken: water-filling to the caps, whole copies, then whatever fits in seeded order."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, total, target = set(sizes), sum(sizes.values()), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * weight[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * weight[s]
        total -= sum(target[s] for s in full)
        open_ -= full or open_
    taken = Counter()
    for s, size in sizes.items():
        whole = int(target[s] // size) if size else 0
        need = target[s] - whole * size
        place = lambda r: hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15]
        passed = False  # texts without words come along up to the first document that doesn't fit
        for r in sorted((r for r in rows if r[3] == s), key=place):
            n = len((r[1] or "").split())
            fits = n <= need and (n > 0 or not passed)
            taken[r] += whole + fits
            passed |= n > need
            need -= n * fits
    return +taken


def test_pipeline_runs_like_plain_python(spark, tmp_path):
    draw = random.Random(3)
    text = lambda n: " ".join(f"v{draw.randrange(5000)}" for _ in range(n))
    rows = [(i, "\n".join(text(9 + i % 13) for _ in range(1 + i % 6)), "en", f"s{i % 4}", 1) for i in range(120)]
    rows += [(200 + i, f"{text(4)} vile1 vile2 vile3 {text(4)} vile1 vile2 vile3", "en", "s1", 1) for i in range(40)]
    long, a, b, c, copy = text(30), text(4), text(5), text(3), text(90)
    near = copy.replace(copy.split()[-1], "other")
    rows += [
        (300, f"{long}\n{text(12)}", "en", "s0", 1), (301, f"{text(12)}\n {long} \n{text(8)}", "en", "s0", 1),  # a long line
        (302, f"{a}\n{b}\n\n{c}\n{text(9)}", "en", "s1", 1), (303, f"{text(9)}\n{a}\n{b}\n{c}", "en", "s2", 1),  # a passage
        (304, f"{a}\n{b}\n{c}", "en", "s2", 1), (305, f"{a}\n{b}\n{text(9)}", "en", "s2", 1),  # nothing left; too short
        (310, copy, "en", "s3", 1), (310, copy, "en", "s3", 1), (311, near, "en", "s3", 1), (311, near, "en", "s3", 1), (312, copy, "en", "s0", 1),
        (313, text(60), "en", "s2", 1), (314, text(400), "en", "s2", 1),
        (None, copy, "en", "s1", 1), (None, text(6), "en", None, 1), (320, None, "en", "s0", None), (321, "", "en", "s0", 0),
    ]
    rows.append(next(r for r in rows if r[0] == 313))  # a repeated row
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(r[0] >= 200)) for r in rows[:160]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (made,) = set(folder.glob("pipeline-*")) - before

    def stage(name):
        (path,) = made.glob(f"?-{name}.parquet")
        return [tuple(r) for r in spark.read.parquet(str(path)).collect()]

    def measured(rows):
        return [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]

    calm = [r for r in rows if "vile3" not in (r[1] or "")]
    assert Counter(stage("toxicity")) == Counter(calm)
    lines = measured(_plain_lines(calm))
    assert Counter(stage("line_dedup")) == Counter(lines) and len(lines) < len(calm)
    single = _plain_join(lines)
    assert Counter(stage("jaccard_join")) == Counter(single) and len(single) < len(lines)
    mix = _plain_mix(single)
    assert Counter(stage("source_mix")) == mix and len(mix) < mix.total()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == sum((Counter({r[0]: n}) for r, n in mix.items()), Counter())
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for of in sequences.values():
        ends = [at + n for at, n in sorted(of)]
        assert [at for at, _ in sorted(of)] == [0, *ends[:-1]] and ends[-1] <= queries.CAPACITY
