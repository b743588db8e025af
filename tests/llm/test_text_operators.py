"""Operators on texts against brute force and on edge cases."""

from __future__ import annotations

import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from comarca.llm import chat, jaccard_join, language, line_dedup, mixing, packing, quality, queries, textbytes, token_counts, toxicity
from comarca.llm.components import components
from comarca.llm.lineage import cut, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n a \n", None, "a▁b ▁ c", "<s> </s>", "a <|endoftext|> b", "a   b",
       "   x", "don't 's", "\x00 x", "x" * 3000, "  \t x y", " " * 90 + "z", "漢字 かな　x", "1 22\n\n\n6 $$ é"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, cls string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [(i, t, f"s{i % 3}") for i, t in enumerate(ODD)] + [(None, "no id", None), (3, "a", "s0"), (3, "a", "s0")])


def test_token_counts_equal_the_library(odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert token_counts.count_texts(pa.array(ODD), queries.piece_model()).tolist() == [len(model.encode(t or "")) for t in ODD]
    rows = token_counts.token_counts(odd, queries.piece_model(), 2).collect()
    assert len(rows) == len(ODD) + 3
    assert {r.n_bytes for r in rows if r.doc_id == 18} == {7}
    assert all(r.over_limit == (r.n_tokens > 2) for r in rows)
    assert token_counts.token_counts(odd.limit(0), queries.piece_model()).count() == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    vocabulary = queries.byte_vocabulary()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [model.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [x.tolist() for x in packing.token_ids(pa.array(ODD), vocabulary)] == expected


def test_packing_is_whole_and_gapless(odd):
    vocabulary = queries.byte_vocabulary()
    rows = packing.packed(odd, vocabulary, capacity=64, per_chunk=3).collect()
    ids = dict(zip(range(len(ODD)), ([*x.tolist(), 0] for x in packing.token_ids(pa.array(ODD), vocabulary)), strict=True))
    for r in rows:
        if r.doc_id in ids:
            piece = ids[r.doc_id][r.start : r.start + r.length]
            assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows if r.doc_id in ids) == sum(map(len, ids.values())) + 2 * len(ids[3])
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(odd.limit(0), vocabulary).count() == 0


def test_packing_search_beats_or_equals_best_fit():
    random = np.random.default_rng(4)
    for _ in range(25):
        counts = np.bincount(random.integers(20, 61, random.integers(1, 80)), minlength=101)
        found, plain = packing.pack_lengths(counts, 100), packing.best_fit(counts, 100)
        used = np.zeros_like(counts)
        for pattern, n in found.used:
            assert sum(pattern) <= 100
            np.add.at(used, list(pattern), n)
        assert (used == counts).all()
        assert packing.lower_bound(counts, 100) <= found.sequences <= plain.sequences
    # 6 + 4 = 5 + 5 = 10 twice over: best fit decreasing needs a sequence more than the search.
    counts = np.bincount([44, 28, 28, 36, 36, 28, 50, 50], minlength=101)
    assert packing.pack_lengths(counts, 100).sequences == 3


def _linked(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, words, percent):
    random = np.random.default_rng(words)
    rows, base = [(i, t) for i, t in enumerate(ODD)], []
    for k in range(14):
        base = [f"w{x}" for x in random.integers(0, 30 if k % 3 else 400, 20 + 8 * k)]
        for _ in range(9):
            text = list(base)
            for at in random.integers(0, len(text), random.integers(0, 4)):
                text[at] = f"N{random.integers(0, 99)}"
            rows.append((100 + len(rows), " ".join(text)))
    table = documents(spark, [(i, t, "s") for i, t in rows] + [(None, "w1 w2 w3 w4", "s")])
    found = jaccard_join.linked(table, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == _linked(rows, words, percent)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert jaccard_join.linked(table.limit(0)).count() == 0


def test_repeated_id_ties_its_texts_together(spark):
    rows = [(1, "a b c d", "s"), (2, "e f g h", "s"), (3, "a b c d", "s"), (3, "e f g h", "s"), (4, "i j k", "s")]
    found = jaccard_join.linked(documents(spark, rows), 3, 90).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    expected = {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)} | {201: 200}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_line_dedup_finds_runs_and_extends_them(spark):
    a, b, c, short = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 6), ("b", 7), ("c", 8), ("s", 3)))
    long = " ".join(f"l{k}" for k in range(60))
    rows = [
        (1, f"{a}\n{b}\n{c}\nown one", "s"),
        (2, f"start\n{a}\n\n {b} \n{c}\nown two", "s"),
        (3, f"{long}\n{short}\nrest", "s"),
        (4, f"before\n{long}\n{short}\nother", "s"),
        (5, f"{a}\n{b}\nnot the third", "s"),
        (6, f"{a}\n{b}\n{c}\nown one", "s"),
        (7, None, "s"),
        (8, "", "s"),
        (None, f"{long}", "s"),
    ]
    found = {r.doc_id: r for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[1].n_removed == 0
    assert found[2].text == "start\n\nown two" and (found[2].n_lines, found[2].n_removed) == (5, 3)
    assert found[3].n_removed == 0
    assert found[4].text == "before\nother"  # the short line goes with the long one
    assert found[5].n_removed == 0
    assert found[6].text == "" and found[6].n_removed == found[6].n_lines == 4
    assert found[7].text is None and found[8].text == "" and found[None].text == long
    assert {r.rank for r in found.values()} == {7}
    assert line_dedup.deduplicated(documents(spark, rows).limit(0)).count() == 0
    twice = documents(spark, [(1, long, "s"), (1, long, "s")])
    assert [r.n_removed for r in line_dedup.deduplicated(twice).collect()] == [0, 0]


def _without_repeats(texts, min_lines, min_words):
    """Lines left of each text, from every run of every length written out."""
    lines = [[x.strip(" \t\x0b\x0c\r") for x in t.split("\n") if WORD.search(x)] for t in texts]
    seen, gone = set(), [set() for _ in lines]
    for of, own in enumerate(lines):
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if b - a >= min_lines or sum(len(WORD.findall(x)) for x in own[a:b]) >= min_words:
                    if tuple(own[a:b]) in seen:
                        gone[of].update(range(a, b))
                    seen.add(tuple(own[a:b]))
    return [[x for k, x in enumerate(own) if k not in gone[of]] for of, own in enumerate(lines)]


@pytest.mark.parametrize(("min_lines", "min_words"), [(3, 25), (3, 5), (2, 4), (1, 9), (4, 6)])
def test_line_dedup_equals_all_runs_written_out(spark, min_lines, min_words):
    rng = np.random.default_rng(min_lines + min_words)
    kinds = ["a", "b b", "c c c", " ".join("d" * 5), " ".join("e" * 26), "f f", ""]
    texts = ["\n".join(rng.choice(kinds, rng.integers(1, 9))) for _ in range(60)]
    found = line_dedup.deduplicated(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), min_lines, min_words).collect()
    expected = _without_repeats(texts, min_lines, min_words)
    for r in found:
        left = [x for x in r.text.split("\n") if x]
        assert left == expected[r.doc_id] and r.n_lines - r.n_removed == len(left), (texts[r.doc_id], r.text)


def test_line_dedup_longest_earlier_match_counts(spark):
    long = " ".join(f"l{k}" for k in range(30))
    rows = [(0, long, "s"), (1, f"{long}\nx\ny", "s"), (2, f"{long}\nx\ny\nown", "s")]
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert found == {0: long, 1: "x\ny", 2: "own"}


def test_line_dedup_of_long_texts(spark):
    """Texts of 20,000 lines, of which one repeats 15,000 of the other's."""
    first = [f"line {k} of the first" for k in range(20_000)]
    second = [f"own {k}" for k in range(5_000)] + first[2_000:17_000]
    rows = [(1, "\n".join(first), "s"), (2, "\n".join(second), "s"), (3, "\n".join(["same"] * 20_000), "s")]
    found = {r.doc_id: r for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == 15_000 and found[2].text == "\n".join(second[:5_000])
    assert found[3].text == "same"


def test_mixing_fills_to_the_caps(spark):
    rows = [(i, "w " * (1 + i % 7), "abcd"[min(i % 9, 3)]) for i in range(300)] + [(900, None, "e"), (901, "x y", None), (None, "z", "a")]
    found = mixing.mixed(documents(spark, rows)).collect()
    assert len(found) == len(rows) and {r.rank for r in found} == {7}
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    assert sum(of[0].target for of in by.values()) == pytest.approx(sum(r.size for r in found))
    for of in by.values():
        assert sum(r.size for r in of) == of[0].source_size
        assert of[0].target <= 3 * of[0].source_size + 1e-9
        assert abs(sum(r.size * r.copies for r in of) - of[0].target) <= 7
        assert all(0 <= r.copies <= 3 for r in of)
    again = mixing.mixed(documents(spark, rows).repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source)
    assert [r.copies for r in sorted(found, key=key)] == [r.copies for r in sorted(again, key=key)]
    assert mixing.repeated(mixing.mixed(documents(spark, rows)), ["doc_id", "text"]).count() == sum(r.copies for r in found)
    assert mixing.mixed(documents(spark, rows).limit(0)).count() == 0


def test_components_stop_where_every_node_hangs_on_a_root(spark, monkeypatch):
    """The driver plans and keeps as little as there is to do: no round only to see that nothing changes."""
    from comarca.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "cut", lambda df: (rounds.append(1), cut(df))[1])
    stars = [((1, "a"), (5, "a")), ((6, "b"), (1, "a")), ((2, "x"), (9, "")), ((2, "x"), (9, "")), ((3, "s"), (3, "s")), (None, (4, "z"))]
    kind = "struct<doc_id:bigint,row:string>"
    found = components(spark.createDataFrame(stars, f"a {kind}, b {kind}"), "a", "b")
    assert sorted((r.node.doc_id, r.component.doc_id) for r in found.collect()) == [(5, 1), (6, 1), (9, 2)] and len(rounds) == 1
    rounds.clear()
    found = components(spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a bigint, b bigint"), "a", "b")
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (4, 1)] and len(rounds) >= 2


def test_a_round_of_the_mix_writes_twice(spark, monkeypatch):
    names = []
    monkeypatch.setattr(mixing, "written", lambda df, name: (names.append(name), written(df, name))[1])
    rows = [(i, "w " * (40 if i == 0 else 3 + (i * 7) % 11), "a" if i < 60 else "b") for i in range(120)]
    mixing.mixed(documents(spark, rows), further=True).collect()
    rounds = names.count("mix-round")
    assert rounds >= 2 and len(names) == 3 + 2 * rounds


def test_training_rows_stay_in_columns(spark):
    """What the driver learns from: Arrow's columns, not objects of Python."""
    chosen = np.array(sorted(int(toxicity._of_text(w)[0]) for w in ("men", "women", "vile")), np.uint64)
    at = {w: int(np.searchsorted(chosen, toxicity._of_text(w)[0])) for w in ("men", "women", "vile")}

    rows = toxicity._training_rows(spark.createDataFrame([("vile men", 1), ("nothing", 0), ("vile", 1)], "text string, toxic int"), chosen)
    assert isinstance(rows, pa.Table)
    found = sorted(zip(*(rows[c].to_pylist() for c in ("toxic", "features", "swapped")), strict=True), key=str)
    expected = [(0, [], None), (1, [at["vile"]], None), (1, sorted([at["vile"], at["men"]]), sorted([at["vile"], at["women"]]))]
    assert found == sorted(expected, key=str)
    row, col = toxicity._sparse(rows["features"])
    assert len(row) == len(col) == 3 and np.bincount(row, minlength=3).tolist() == [len(x) for x in rows["features"].to_pylist()]


def test_mixing_takes_every_later_document_that_fits(spark):
    """Sources with one document of a tenth to a half of their words, against taking one by one."""
    import hashlib

    rows, sizes = [], {}
    for source, share in (("a", 0.5), ("b", 0.1), ("c", 0.3), ("d", 0.4), ("e", 0.2)):
        for k in range(60):
            doc = 1000 * "abcde".index(source) + k
            sizes[doc] = round(60 * 8 * share / (1 - share)) if k == 0 else 3 + (k * 7) % 11
            rows.append((doc, "w " * sizes[doc], source))
    rows += [(None, "x y z", "a"), (None, "x y z u v", "a"), (7, "x " * sizes[7], "a"), (9000, None, "f"), (9001, "", "a")]
    found = mixing.mixed(documents(spark, rows), further=True).collect()
    assert len(found) == len(rows)
    for source in "abcdef":
        of = [r for r in found if r.source == source]
        left = of[0].target - sum(r.size * r.copies for r in of)
        whole = of[0].target // of[0].source_size if of[0].source_size else 0
        assert left > -1e-6 and all(whole <= r.copies <= whole + 1 for r in of)
        if source in "bcde":
            need, once = of[0].target - whole * of[0].source_size, set()
            for doc in sorted((r.doc_id for r in of), key=lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()[:15]):
                if sizes[doc] <= need:
                    need -= sizes[doc]
                    once.add(doc)
            assert {r.doc_id for r in of if r.copies > whole} == once
            assert not [r for r in of if r.copies == whole and 0 < r.size <= left]
    assert mixing.mixed(documents(spark, rows).limit(0), further=True).count() == 0


def _statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_rules(spark):
    run = " ".join(f"r{k}" for k in range(9))
    texts = [*ODD, f"{run} x {run}", f"{run}\n{run}\nq", "same " * 40]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for k in range(400):
        bad = k % 4 == 0
        rows.append((1000 + k, " ".join(f"w{k}_{j}{'#$' if bad and j % 3 == 0 else ''}" for j in range(30 + k % 50)), "s"))
    labels = spark.createDataFrame([(1000 + k, int(k % 4 != 0), 0) for k in range(400)] + [(None, 1, 0), (1001, None, 0)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judged(documents(spark, rows), labels).collect()}
    for i, text, _ in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _statistics(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(found[1000 + k].kept == (k % 4 != 0) for k in range(400))
    none = quality.judged(documents(spark, rows), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.judged(documents(spark, []), labels).count() == 0


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "user", "and"), (1, 3, "assistant", "B"), (1, 4, "user", "tail"),
             (2, 0, "user", "hi"), (2, 1, "assistant", "only"), (3, 0, "user", "no answer"), (4, 5, "assistant", "x"), (4, 9, "assistant", "x"),
             (None, 0, "user", "hi"), (2, 1, "assistant", "only"), (5, 0, None, None), (6, 0, "assistant", "")]
    placed = chat.placed(spark.createDataFrame(turns, "pair_id bigint, turn bigint, role string, text string"))
    found = {r.pair_id: r for r in chat.preferences(*chat.ablated(placed)).collect()}
    assert sorted(found) == [1, 2, 4]
    one = found[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n<|im_start|>user\nand<|im_end|>\n"
    assert (one.chosen, one.rejected) == ("<|im_start|>assistant\nB<|im_end|>\n", "<|im_start|>assistant\nA<|im_end|>\n")
    for completion, mask in ((one.chosen, one.chosen_mask), (one.rejected, one.rejected_mask)):
        assert [completion[a : a + n] for a, n in mask] in (["B<|im_end|>"], ["A<|im_end|>"])
    assert found[2].rejected == "<|im_start|>assistant\n<|im_end|>\n" and found[2].n_prompt_turns == 1


def test_language_marginalises_all_segmentations():
    pieces = [b" a", b" ", b"a", b"b", b"ab", b" ab"]
    probability = np.array([[0.2], [0.1], [0.3], [0.1], [0.2], [0.1], [0.0]])
    model = language.Model(["x"], pieces, probability)
    data, offsets = textbytes.text_column(pa.array(["ab"]))
    spaced, starts, sizes, _ = language.words_of(data, offsets)
    # " ab" = " ab" | " a"+"b" | " "+"ab" | " "+"a"+"b"
    expected = 0.1 + 0.2 * 0.1 + 0.1 * 0.2 + 0.1 * 0.3 * 0.1
    assert language.word_scores(model, spaced, starts, sizes)[0, 0] == pytest.approx(np.log(expected))
    counts = language.expected_counts(model, spaced, starts, sizes, np.zeros(1, int), np.ones(1))[:, 0]
    assert counts @ [2, 1, 1, 1, 2, 3, 0] == pytest.approx(3)  # bytes that the pieces cover


def _segmentations(word, pieces):
    """Every way to write `word` as pieces, one after the other."""
    if not word:
        yield []
    for i, p in enumerate(pieces):
        if word.startswith(p):
            yield from ([i, *rest] for rest in _segmentations(word[len(p):], pieces))


def test_language_equals_every_segmentation_written_out(monkeypatch):
    rng = np.random.default_rng(4)
    pieces = [b" ", b"a", b"b", b"c", b"ab", b"ba", b"abc", b" a", b"bab", b"cab", b"\xc3", b"\xa9", b"\xc3\xa9", b"\xa9a"]
    probability = rng.random((len(pieces) + 1, 3))
    probability[-1] = 0
    model = language.Model(["x", "y", "z"], pieces, probability / probability.sum(axis=0))
    texts = ["".join(rng.choice(list("abcé"), n)) for n in (1, 2, 3, 5, 8, 9, 10)] + ["c c", "ccccc"]
    for held in (1 << 16, 7):
        monkeypatch.setattr(language, "HELD_BYTES", held)
        data, offsets = textbytes.text_column(pa.array(texts))
        spaced, starts, sizes, rows = language.words_of(data, offsets)
        scores = language.word_scores(model, spaced, starts, sizes)
        of, times = np.arange(len(starts)) % 3, np.arange(len(starts)) + 0.5
        counts = np.zeros_like(model.probability)
        for k, (a, n) in enumerate(zip(starts, sizes)):
            ways = list(_segmentations(spaced[a : a + n].tobytes(), pieces))
            likely = np.array([model.probability[w].prod(axis=0) for w in ways])
            assert scores[k] == pytest.approx(np.log(likely.sum(axis=0)))
            for way, p in zip(ways, likely[:, of[k]] / likely[:, of[k]].sum()):
                np.add.at(counts[:, of[k]], way, p * times[k])
        assert language.expected_counts(model, spaced, starts, sizes, of, times) == pytest.approx(counts)


def test_language_words_of_any_length():
    """A run of 20,000 letters underflows as a product; its score is that of the recursion on logarithms."""
    pieces = [b" ", b"a", b"aa", b"aaa" * 16]
    model = language.Model(["x"], pieces, np.array([[0.5], [1e-4], [0.4], [1e-6], [0.0]]))
    data, offsets = textbytes.text_column(pa.array(["a" * 20_000]))
    spaced, starts, sizes, _ = language.words_of(data, offsets)
    assert sizes.tolist() == [20_001]
    best = [0.0, np.log(1e-4)]
    for n in range(2, 20_001):
        best.append(np.logaddexp(best[-1] + np.log(1e-4), best[-2] + np.log(0.4)))
        if n >= 48:
            best[-1] = np.logaddexp(best[-1], best[-49] + np.log(1e-6))
    assert language.word_scores(model, spaced, starts, sizes)[0, 0] == pytest.approx(np.log(0.5) + best[20_000])


def test_language_held_out_and_edges(spark, odd):
    path = "/root/testdata/sf0.01"
    found = queries.op1_language(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    none = language.identified(odd, language.fit(odd.limit(0), queries.piece_model())).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    model = language.fit(odd, queries.piece_model())
    rows = {r.doc_id: r for r in language.identified(odd, model).collect()}
    assert rows[0].lang_pred == "und" and rows[9].lang_pred == "und" and rows[17].lang_pred == "en" and 0 <= rows[17].score <= 1


def test_toxicity_held_out_and_swaps(spark, odd):
    path = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = found.filter("held_out").select("toxic", "predicted").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert caught > 0.8 and wrong < 0.01
    # Toxic texts mention one group, clean ones another: with the penalty the mention decides less.
    texts = [(i, f"{'women' if i % 2 else 'men'} filler{i % 7} {'scum' if i % 2 and i % 3 else 'calm'}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(texts, "doc_id bigint, text string, toxic int")
    probe = pa.array(["women filler1", "men filler1"])
    plain, fair = (np.ptp(toxicity.fit(labelled, fairness=f).scores(probe)) for f in (0.0, 10.0))
    assert fair < plain / 3
    none = toxicity.fit(labelled.limit(0))
    scored = toxicity.scored(odd, none).collect()
    assert len(scored) == odd.count() and {r.predicted for r in scored} == {0}


def test_training_rows_are_drawn_by_id(spark):
    documents = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "1 AS toxic")
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    strangers = spark.range(1000, 6000).selectExpr("id AS doc_id", "0 AS toxic")
    odd = spark.createDataFrame([(0, 1), (None, 1), (2, None), (4, 7)], "doc_id bigint, toxic int")
    every = toxicity.training_rows(documents, labels.union(odd)).collect()
    assert sorted(r.doc_id for r in every) == list(range(1, 400))
    assert all(r.toxic == r.doc_id % 2 and r.text == f"text {r.doc_id}" for r in every)
    few = toxicity.training_rows(documents, labels, 100)
    shuffled = toxicity.training_rows(documents, labels.union(strangers), 100)
    drawn = sorted(r.doc_id for r in few.collect())
    assert 50 <= len(drawn) <= 150 and drawn == sorted(r.doc_id for r in shuffled.collect())
    hinted = [df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for df in (few, shuffled)]
    assert hinted == [1, 0]
    assert toxicity.training_rows(documents.limit(0), labels).count() == toxicity.training_rows(documents, labels.limit(0)).count() == 0


def _thue_morse(size, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def _colliding():
    """Strings that a polynomial hash modulo a power of two cannot tell apart."""
    return [_thue_morse(n, x) for n in (1024, 2048, 4096) for pair in ("ab", "xy", "éü") for x in (pair, pair[::-1])]


def test_hashes_tell_constructed_strings_apart():
    texts = [*_colliding(), "abc", "abc\0\0\0\0\x03", "a", "a\0", "abcdefgh", "abcdefghi", "y" * 64, "y" * 65]
    data, offsets = textbytes.text_column(pa.array(texts * 2))
    hasher = textbytes.Hasher(data)
    for hashes in (hasher.of(offsets[:-1], offsets[1:]), hasher.strong(offsets[:-1], offsets[1:])):
        assert len(set(hashes.tolist())) == len(texts) and (hashes[: len(texts)] == hashes[len(texts) :]).all()
    where, back = hasher.groups(offsets[:-1], offsets[1:])
    assert len(where) == len(texts) and (where[back] == np.tile(np.arange(len(texts)), 2)).all()


def test_groups_do_not_trust_the_hash(monkeypatch):
    texts = ["ab", "cd", "ab", "z" * 70, "w" * 70, "z" * 70, "abcdefghij", "abcdefghik"]
    monkeypatch.setattr(textbytes.Hasher, "of", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    data, offsets = textbytes.text_column(pa.array(texts))
    where, back = textbytes.Hasher(data).groups(offsets[:-1], offsets[1:])
    assert [texts[i] for i in where[back]] == texts and len(where) == 6


def test_constructed_strings_keep_their_own_results(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = _colliding()
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert token_counts.count_texts(pa.array(texts), queries.piece_model()).tolist() == [len(pieces.encode(t)) for t in texts]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.token_ids(pa.array(texts), queries.byte_vocabulary())] == expected
    rows = jaccard_join.linked(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), words=3, percent=90).collect()
    assert all(r.doc_id == r.component_id and r.n_shingles == 1 for r in rows) and len(rows) == len(texts)


def test_words_lose_all_punctuation_at_their_ends():
    texts = ["......bad!!!!!!!", "((((((a-b))))))", "?????", "x", "", "a.... ....b"]
    data, offsets = textbytes.text_column(pa.array(texts))
    starts, ends, _ = toxicity._trimmed_words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["bad", "a-b", "?", "x", "a", "b"]


def test_extra_columns_may_have_any_name(spark):
    names = ["whole", "upto", "closing", "_s", "_n", "_row", "_doc", "_gone", "_texts", "_keep", "place", "rounds", "copies", "_others", "a.b", "n_lines", "size"]
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{line}\nown {i}" if i < 3 else "short", f"s{i % 2}") for i in range(6)]
    df = spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in names)) for r in rows], ["doc_id", "text", "source", *names])
    for further in (False, True):
        mix = mixing.mixed(df, further=further).collect()
        assert len(mix) == 6 and all(r["_s"] == f"_s-{r.doc_id}" and r["a.b"] == f"a.b-{r.doc_id}" and r["upto"] == f"upto-{r.doc_id}" for r in mix)
        assert all(isinstance(r["copies"], int) and isinstance(r["size"], int) for r in mix)
    lines = line_dedup.deduplicated(df).collect()
    assert {r.doc_id: r.n_removed for r in lines} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert all(r["_row"] == f"_row-{r.doc_id}" and r["_gone"] == f"_gone-{r.doc_id}" and r["_others"] == f"_others-{r.doc_id}" for r in lines)
    assert [f for f in lines[0].asDict() if f in ("n_lines", "n_removed")] == ["n_lines", "n_removed"]


def test_new_chunks_are_encoded_together(monkeypatch):
    vocabulary = queries.byte_vocabulary()
    model, encode, odd, widths = packing._model(vocabulary)
    calls = []
    counted = lambda text: calls.append(text) or encode(text)
    monkeypatch.setitem(packing._models, vocabulary.whole, (model, counted, odd, widths))
    monkeypatch.setitem(packing._known, vocabulary.whole, {})
    texts = [" ".join(f"w{k}x{k * k}é" for k in range(3000)), "a  b\n\nc\td 12's !!  ", " \x00z ǘ 日本 's", "", None, "x   y 　z"]
    found = [x.tolist() for x in packing.token_ids(pa.array(texts), vocabulary)]
    assert found == [model.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(calls) < 30
    # Invalid UTF-8 and other white space between chunks: the same as each chunk alone.
    for names in ([b" a\xff", b" b"], [b" a\xc2\xa0", b" \xc2\xa0x", b" b"], [b" \xe6\x97", b" c"], [b" ", b"  ", b"x", b" x"], []):
        alone = [np.array(encode(x.decode("utf-8", "replace")), "<u4").tobytes() for x in names]
        assert packing._chunk_ids(names, encode, widths) == alone


def test_chunks_are_handled_as_columns(monkeypatch):
    vocabulary = queries.byte_vocabulary()
    monkeypatch.setitem(packing._known, vocabulary.whole, {})
    monkeypatch.setattr(packing, "SLICE_BYTES", 3000)
    model = packing._model(vocabulary)[0]
    rows = [" ".join(f"w{k % 900}x{k}é" if k % 3 else f"the{k % 7}" for k in range(j, j + 60)) for j in range(0, 20_000, 60)]
    texts = pa.array([*rows, "", None, "b\n\nc\td  ", "x" * 9000, " " + "y" * 9000, *rows[::-1]])
    # Repeated slices, slices of one long chunk, and a memory that is full now and then or all the time.
    expected = [model.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
    for most in (50_000, 4000, 0):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        assert [x.tolist() for x in packing.token_ids(texts, vocabulary)] == expected
    # What a worker remembers are a few columns, not objects for each chunk.
    monkeypatch.setattr(packing, "REMEMBERED", 10_000_000)
    before = sys.getallocatedblocks()
    assert sum(1 for _ in packing.token_ids(texts, vocabulary)) == len(texts)
    assert sys.getallocatedblocks() - before < 2000
