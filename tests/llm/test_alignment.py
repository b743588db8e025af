"""Alignment of two tokenizers against a plain version, and on edge cases."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers

from comarca.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", " a ", "a▁b", "▁", "<s> x </s> <unk>", "a <|endoftext|> b", "<|endoftext|>", "<0x41>", "\x00 \x01", "漢字 かな　x",
       "é́ ﬁ ℌ", "tab\t\tnew\n\n\nline", "x" * 3000, "ab" * 700 + " " * 300, "🙂🙃 🇩🇪", "don't 1234567 $$$", "﻿bom", "a b c", "word " * 4000]


def _plain(rows):
    """Measures of each (doc_id, text), and the counts of the id pairs, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(x): x for x in visible}
    for x in range(256):
        if x not in visible:
            byte_of[chr(256 + len(byte_of) - len(visible))] = x
    counts, per_text = Counter(), []
    for _, text in rows:
        raw = f" {text}".encode() if text else b""
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spelt = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]]]
        spelt.append([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(s) != raw for s in spelt):
            ids, spelt = [[], []], [[], []]
        ends = []
        for side in (0, 1):
            at, here = 0, {}
            for i, piece in zip(ids[side], spelt[side], strict=True):
                at += len(piece)
                here[at] = i
            ends.append(here)
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        groups, rest = [], [iter(ends[0].items()), iter(ends[1].items())]
        for e in sorted(ends[0].keys() & ends[1].keys()):
            group = [[], []]
            for side in (0, 1):
                for at, i in rest[side]:
                    group[side].append(str(i))
                    if at == e:
                        break
            groups.append("|".join(",".join(x) for x in group))
        counts.update(links)
        per_text.append((len(ids[0]), len(ids[1]), groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    found = []
    for (name, _), (n_a, n_b, groups, links) in zip(rows, per_text, strict=True):
        best = sum(counts[x] == most[x[1]] for x in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((name, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), sha))
    return found, {(x, y, n, n == most[y]) for (x, y), n in counts.items()}


def _key(row):
    return row[0] is not None, row


def test_odd_texts_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    rows = [*enumerate(ODD), (None, "no id"), (3, "a"), (3, "a"), *((100 + i, "a copy of many") for i in range(50))]
    docs = spark.createDataFrame([(*r, 1, "s", b"k", 2) for r in rows], "doc_id bigint, text string, weight int, slice string, key binary, n_a int")
    found, pairs = alignment.alignments(docs.repartition(3), queries.byte_vocabulary(), queries.piece_model())
    expected, expected_pairs = _plain(rows)
    assert sorted(map(tuple, found.collect()), key=_key) == sorted(expected, key=_key)
    assert {tuple(r) for r in pairs.collect()} == expected_pairs
    assert sum(r[1] > 0 for r in expected) > 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    found, pairs = alignment.alignments(docs, queries.byte_vocabulary(), queries.piece_model())
    assert sorted(map(tuple, found.collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)] and pairs.count() == 0
    assert alignment.alignments(docs.limit(0), queries.byte_vocabulary(), queries.piece_model())[0].count() == 0


def test_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_alignment(spark, FOLDER).collect())) == sorted(_plain(rows)[0])
