"""Deletion of repeated runs of lines, found by winnowing over line hashes.

A window begins at a line and ends as soon as it has `min_lines` lines or `min_words` words. The
place of the smallest line hash in it is its fingerprint; windows one after the other mostly share
theirs, and only places selected by some window are stored, with the line hashes around them.
Equal windows have equal fingerprints at the same place, so every repeated run is found where its
fingerprints meet. Places whose fingerprint occurs once go.

Around the others matches grow both ways: back to the beginnings of the windows that selected the
place, forward over their ends and on through lines that are too few or too short for a window of
their own. Each such stretch is looked up among the earlier ones, so a line is deleted exactly if it
lies in a run of `min_lines` lines or `min_words` words that some earlier place has too, whichever it
is: the longest earlier match counts, not the first occurrence of its beginning.

All of it is DataFrame expressions. Lines are compared by 128-bit hashes. Places are never paired with
each other: a group keeps its first place, found by parts (`SALTS`), and each part meets that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.llm.lineage import cut
from comarca.llm.tables import apart

WHITE = " \t\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which the rows of one fingerprint or one stretch are split.
SALTS = 16


def _lines(text: str) -> Column:
    """The lines of a text that have a word: hash without outer white space, words."""
    each = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(
            F.unhex(F.md5(F.btrim(line, F.lit(WHITE)))).alias("h"),
            F.regexp_count(line, F.lit(WORD)).alias("w"),
        ),
    )
    return F.filter(each, lambda x: x["w"] > 0)


def _end(i: Column, min_lines: int, min_words: int) -> Column:
    """Where the window that begins at line i ends (exclusive)."""
    words, chain = F.lit(0), F
    for k in range(min_lines - 1):
        words = words + F.get(F.col("lines"), i + k)["w"]
        chain = chain.when(words >= min_words, i + k + 1)
    return chain.otherwise(i + min_lines) if min_lines > 1 else i + 1


def _fingerprints(documents: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """One row per selected place: the line at which the first of its windows begins (`i`), for that window and
    the next ones the shortest and longest stretch to look up (`sizes`, `reaches`), and the line hashes from `i` on.

    Both the ends of windows and their selected places never decrease from window to window. A window's stretch
    reaches on to the line before the next window's end: from there on the next window covers the match."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("row"), _lines("text").alias("lines"))
    every = F.transform(F.col("lines"), lambda x, i: _end(i, min_lines, min_words))
    rows = rows.select("doc_id", "row", F.col("lines.h").alias("hs"), F.filter(every, lambda e: e <= F.size("lines")).alias("ends"))

    def place(e: Column, i: Column) -> Column:
        own = F.slice("hs", i + 1, e - i)
        return i + F.array_position(own, F.array_min(own)).cast("int") - 1

    rows = rows.select("*", F.transform("ends", place).alias("places"))

    def of_windows(k: Column, p: Column, value) -> Column:
        ahead = F.array(*[F.lit(d) for d in range(min_lines)])
        return F.transform(F.filter(ahead, lambda d: F.get("places", k + d) == p), lambda d: value(k + d))

    def size(j: Column) -> Column:
        return F.get("ends", j) - j

    def reach(j: Column) -> Column:
        return F.greatest(F.coalesce(F.get("ends", j + 1) - 1, F.size("hs")) - j, size(j))

    def selected(p: Column, k: Column) -> Column:
        new = (k == 0) | (F.get("places", k - 1) != p)
        return F.when(new, F.struct(k.alias("i"), p.alias("place"), of_windows(k, p, size).alias("sizes"), of_windows(k, p, reach).alias("reaches")))

    chosen = F.filter(F.transform("places", selected), lambda x: x.isNotNull())
    found = rows.select("doc_id", "row", "hs", F.explode(chosen).alias("at")).select("doc_id", "row", "hs", "at.*")
    longest = F.array_max(F.transform("reaches", lambda n, d: n + d))
    return found.select(
        "doc_id", "row", "i", "place", "sizes", "reaches",
        F.get("hs", F.col("place")).alias("fingerprint"), F.slice("hs", F.col("i") + 1, longest).alias("around"),
    )


def _with_group(rows: DataFrame, key: str, least, most) -> DataFrame:
    """`rows` with `least` and `most`, the smallest and greatest of two expressions among rows of the same `key`, where
    these differ. Groups are aggregated, and joined, in `SALTS` parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(least).alias("least"), F.max(most).alias("most"))
    whole = parts.groupBy(key).agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least != most")
    return salted.join(parts.select(key, "salt").join(whole, key), [key, "salt"])


def _repeated(fingerprints: DataFrame) -> DataFrame:
    """Stretches (doc_id, row, start, size) that an earlier place has too."""
    where = F.xxhash64("doc_id", "row", "place")
    met = _with_group(fingerprints, "fingerprint", where, where)

    def stretch(d: Column, size: Column) -> Column:
        joined = F.aggregate(F.slice("around", d + 1, size), F.lit(b""), lambda s, h: F.concat(s, h))
        return F.struct((F.col("i") + d).alias("start"), size.alias("size"), F.unhex(F.md5(joined)).alias("stretch"))

    each = F.transform("sizes", lambda s, d: F.transform(F.sequence(s, F.get("reaches", d)), lambda n: stretch(d, n)))
    stretches = met.select("doc_id", "row", F.inline(F.flatten(each)))
    order = F.struct("doc_id", "row", "start")
    return _with_group(stretches, "stretch", order, order).filter(order > F.col("least")).select("doc_id", "row", "start", "size")


def deduplicated(documents: DataFrame, min_lines: int = 3, min_words: int = 25) -> DataFrame:
    """`documents` (doc_id, text and any other columns) with repeated runs of lines deleted from `text`.

    Added: n_lines and n_removed, the lines with a word and those deleted among them. The occurrence
    with the smallest doc_id, in it the first, stays. Lines are compared without white space at
    their ends; lines without a word are skipped in runs and never deleted, unless no other line is
    left, which makes the text empty. A text that overlaps with itself keeps its first period.
    Rows with a null doc_id or text come back as they are (0 lines removed); rows that repeat both
    are treated alike, none as the other's copy. Empty texts have no lines. Columns of other names
    are carried along; columns named n_lines or n_removed are replaced.
    """
    rows, carried = apart(documents, ("doc_id", "text"), ("n_lines", "n_removed"))
    known = rows.filter("doc_id is not null and text is not null")
    repeated = _repeated(cut(_fingerprints(known, min_lines, min_words)))
    ranges = repeated.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    covered = F.transform("ranges", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))
    gone = ranges.select("doc_id", "row", F.array_distinct(F.flatten(covered)).alias("gone"))

    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    at = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row"))
    found = rows.join(gone, at, "left").drop("_doc", "_row")
    texts = F.split("text", "\n", -1)
    worded = F.filter(F.transform(texts, lambda line, k: F.when(line.rlike(WORD), k)), lambda k: k.isNotNull())
    touched = F.col("_gone").isNotNull()
    found = found.withColumn("_worded", F.when(touched, worded))
    found = found.withColumn("_lost", F.transform("_gone", lambda k: F.get("_worded", k)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(texts) - 1), "_lost")
    found = found.withColumn("_texts", F.when(touched, texts)).withColumn("_keep", F.when(touched, keep))
    kept = F.array_join(F.transform("_keep", lambda k: F.get("_texts", k)), "\n")
    left = F.when(F.size("_gone") == F.size("_worded"), F.lit("")).otherwise(kept)
    lines_of = F.size(F.filter(texts, lambda line: line.rlike(WORD)))
    new = {
        "text": F.when(touched, left).otherwise(F.col("text")),
        "n_lines": F.when(touched, F.size("_worded")).otherwise(F.coalesce(lines_of, F.lit(0))).cast("long"),
        "n_removed": F.when(touched, F.size("_gone")).otherwise(0).cast("long"),
    }
    return found.select(*[new["text"].alias("text") if c == "text" else column for c, column in carried.items()], *[new[k].alias(k) for k in ("n_lines", "n_removed")])


def oracle(min_lines: int = 3, min_words: int = 25) -> str:
    """The same in DuckDB's SQL, for documents with distinct ids and without nulls."""
    ahead = "".join(f", lead(w, {k}) OVER p AS w{k}" for k in range(1, min_lines - 1))
    words = ["w", *[f"w{k}" for k in range(1, min_lines - 1)]][: min_lines - 1]
    sizes = " ".join(f"WHEN {' + '.join(words[:k])} >= {min_words} THEN {k}" for k in range(1, min_lines))
    size = f"CASE {sizes} ELSE {min_lines} END" if sizes else "1"
    return rf"""
    WITH raw AS (
      SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
    ), every AS (
      SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw
    ), worded AS (
      SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
        row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i
      FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), near AS (
      SELECT doc_id, i, w{ahead} FROM worded WINDOW p AS (PARTITION BY doc_id ORDER BY i)
    ), whole AS (
      SELECT doc_id, list(s ORDER BY i) AS ss FROM worded GROUP BY doc_id
    ), runs AS (
      SELECT n.doc_id, n.i, {size} + t AS size, ss
      FROM near n JOIN whole USING (doc_id) CROSS JOIN (SELECT unnest(range({min_lines})) AS t)
    ), ordered AS (
      SELECT doc_id, i, size,
        row_number() OVER (PARTITION BY array_to_string(ss[i + 1 : i + size], chr(10)) ORDER BY doc_id, i) AS nth
      FROM runs WHERE i + size <= len(ss)
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM ordered WHERE nth > 1
    ), marked AS (
      SELECT w.doc_id, w.pos, g.i IS NOT NULL AS gone FROM worded w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i
    ), counted AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id
    ), kept AS (
      SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
      FROM every e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.pos = m.pos
      WHERE NOT coalesce(m.gone, false) GROUP BY e.doc_id
    )
    SELECT r.doc_id, CASE WHEN c.n_removed = c.n_lines THEN '' WHEN coalesce(c.n_removed, 0) = 0 THEN r.text ELSE k.text END AS text,
      coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
    FROM raw r LEFT JOIN counted c ON r.doc_id = c.doc_id LEFT JOIN kept k ON r.doc_id = k.doc_id
    """
