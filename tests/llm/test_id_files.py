"""The id coder and its files: exact round trips, damage, order, edge cases."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comarca.llm import id_coder, id_files, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, file string, place int, start string"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=40), st.integers(0, 3))
def test_any_ids_come_back(ids, repeat):
    ids = np.array(ids * (1 + 9 * repeat), "<u4")
    found, end = id_coder.decode_block(raw := id_coder.encode_block(ids))
    assert (found == ids).all() and len(found) == len(ids) and end == len(raw)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 511, 512, 513, 70_000])
def test_kinds_of_ids_come_back(n):
    draw = np.random.default_rng(n)
    kinds = [draw.integers(0, 1 << 21, n), np.zeros(n, int), draw.integers(0, 2, n), np.arange(n), np.full(n, (1 << 21) - 1), draw.geometric(0.01, n)]
    for ids in kinds:
        assert (id_coder.decode_block(id_coder.encode_block(ids))[0] == ids).all()


def test_predictions_of_each_order_make_blocks_smaller():
    draw = np.random.default_rng(1)
    n, letters = 60_000, 60
    after = draw.integers(0, letters, (letters, letters))
    order1, order2 = [0], [0, 1]
    for x, y in zip(draw.random(n), draw.integers(0, letters, n).tolist(), strict=True):
        order1.append(int(after[0, order1[-1]]) if x < 0.9 else y)
        order2.append(int(after[order2[-2], order2[-1]]) if x < 0.9 else y)
    kinds = {"flat": draw.integers(0, letters, n), "0": np.minimum(draw.geometric(0.3, n), letters - 1), "1": order1, "2": order2}
    bits = {k: 8 * len(id_coder.encode_block(np.array(v[:n]))) / n for k, v in kinds.items()}
    assert bits["flat"] < 6.3 and bits["0"] < 4 and bits["1"] < 2 and bits["2"] < 2


def test_format_stays_and_tables_are_small():
    draw = np.random.default_rng(5)
    ids = np.minimum(draw.geometric(0.002, 90_000), 50_000)
    ids[30_000:60_000] = ids[:30_000]
    assert zlib.crc32(id_coder.encode_block(ids)) == 3339143336
    # Contexts are looked up at random: what they take decides the time.
    model = id_coder._Mixer(50_000)
    assert model.first.nbytes + model.second.nbytes <= 4 * (50_000 + (1 << id_coder.SLOTS))


def test_number_of_rows_is_checked():
    raw = bytearray(id_coder.encode_group([1, 2], [np.arange(3), np.arange(4)]) + id_coder.END)
    for rows in (0, 1, 3, 100):
        raw[4:8] = rows.to_bytes(4, "little")
        with pytest.raises(id_coder.Damaged):
            list(id_coder.decode_groups(bytes(raw)))


def test_carries_go_through_words():
    # Intervals at the very end of the range push `low` towards overflow.
    ids = np.full(3000, 9)
    ids[::7] = 10
    assert (id_coder.decode_block(id_coder.encode_block(ids))[0] == ids).all()


def test_damage_is_told():
    raw = id_coder.encode_group([1, None], [np.arange(5), np.arange(300)]) + id_coder.END
    assert [x.tolist() if hasattr(x, "tolist") else x for x in next(id_coder.decode_groups(raw))[:2]] == [[1, None], [5, 300]]
    for at in range(len(raw)):
        broken = bytearray(raw)
        broken[at] ^= 4
        with pytest.raises((id_coder.Damaged, zlib.error)):
            list(id_coder.decode_groups(bytes(broken)))
    for size in range(1, len(raw)):
        with pytest.raises(id_coder.Damaged):
            list(id_coder.decode_groups(raw[:size]))


def _expected(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, found = 0, []
    for name, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def _read(spark, path):
    rows = id_files.with_starts(id_files.read_ids(spark, str(path)))
    found = rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    return sorted(map(tuple, found), key=lambda r: r[1])


def test_files_hold_documents_in_order(spark, tmp_path, monkeypatch):
    rows = [(5, "five five"), (-2, "minus"), (3, None), (9, ""), (4, "a <|endoftext|> b"), (4, "a <|endoftext|> b"), (None, "no id"), (7, "word " * 9000)]
    docs = spark.createDataFrame([(*r, "f", 1, "s") for r in rows], SCHEMA)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    id_files.write_ids(docs.repartition(3), queries.byte_vocabulary(), f"{tmp_path}/a")
    assert _read(spark, tmp_path / "a") == _expected(ordered)
    # Several texts under one id: all are there, their order is by hash.
    twice = spark.createDataFrame([(1, "one", "f", 1, "s"), (1, "two words", "f", 1, "s")], SCHEMA)
    id_files.write_ids(twice, queries.byte_vocabulary(), f"{tmp_path}/b")
    found = _read(spark, tmp_path / "b")
    assert {(r[0], *r[2:]) for r in found} == {(r[0], *r[2:]) for r in _expected([(1, "one"), (1, "two words")])}
    id_files.write_ids(docs.limit(0), queries.byte_vocabulary(), f"{tmp_path}/c")
    assert _read(spark, tmp_path / "c") == []


def test_many_groups_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "GROUPS_A_FILE", 2)
    monkeypatch.setattr(id_files, "FILES_A_SUM", 2)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 5000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    id_files.write_ids(docs.repartition(5), queries.byte_vocabulary(), f"{tmp_path}/a")
    assert _read(spark, tmp_path / "a") == _expected(rows)
    assert len(list(Path(f"{tmp_path}/a").glob("part-*"))) >= 4


def test_groups_take_no_more_blocks_than_they_must(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 100)
    # Words of one id each; the end id makes them 1, 31, 41, ... ids.
    for words, groups in (
        ([30] * 10, [93, 93, 93, 31]),
        ([99, 99], [100, 100]),
        ([0] * 250, [100, 100, 50]),
        ([9, 140, 60, 60], [151, 61, 61]),
        ([59, 149, 59], [60, 150, 60]),
        ([320, 9], [321, 10]),
    ):
        docs = spark.createDataFrame([(k, " the" * n) for k, n in enumerate(words)], "doc_id bigint, text string")
        found = id_files.encoded(docs.coalesce(1).sortWithinPartitions("doc_id"), queries.byte_vocabulary()).collect()
        decoded = [next(id_coder.decode_groups(bytes(r.payload) + id_coder.END)) for r in found]
        assert [int(sizes.sum()) for _, sizes, _ in decoded] == groups
        assert [n for names, _, _ in decoded for n in names] == list(range(len(words)))


def test_query_reads_back_what_the_library_gives(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()))
    found = queries.op11_id_files(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == _expected(rows)


def test_damaged_file_fails_the_job(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three", "f", 1, "s")], SCHEMA)
    id_files.write_ids(docs, queries.byte_vocabulary(), f"{tmp_path}/a")
    (file,) = (p for p in Path(f"{tmp_path}/a").glob("part-*") if p.stat().st_size)
    raw = bytearray(file.read_bytes())
    raw[-8] ^= 1
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        id_files.read_ids(spark, f"{tmp_path}/a").collect()
