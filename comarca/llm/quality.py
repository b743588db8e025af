"""Quality rules: an ordered list of threshold conjunctions, learnt from labelled statistics.

Statistics of a text are column expressions. Rules are learnt by sequential covering: a rule grows
one threshold condition at a time by information gain on the rows not yet covered, is cut back to
where it separates best on rows that it has not grown on, and then covers its rows. Each step is
one aggregation over the labelled statistics; the driver sees counts per feature and bin only.
The list is a chain of Spark conditionals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.llm.lineage import cut

SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_lines"]


def _pairs(hashes: Column, shift: int) -> Column:
    """Hash of each element with the one `shift` places on."""
    n = F.greatest(F.size(hashes) - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts above for each row of `documents` (doc_id, text), all long.

    n_repeat_words counts the words that lie in windows of eight words found twice or more in the
    text. A null text has no words and zeros throughout. Rows come back one for one.
    """
    text = F.coalesce("text", F.lit(""))
    found = documents.select("doc_id", text.alias("text"))
    found = found.withColumn("words", F.array_remove(F.split("text", SPACE_RUN, -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(NOT_SPACE))
    found = found.withColumn("lines", lines).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4 and 8 words in a row, each from two of half the length.
    for name, before, shift in (("h2", "h", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        found = found.withColumn(name, _pairs(F.col(before), shift))
    twice = F.size(F.array_distinct("h8")) < F.size("h8")
    places = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("placed", F.when(twice, places))
    beside = F.transform(
        "placed",
        lambda x, k: F.when(
            F.coalesce(x["h"] == F.get("placed", k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False)),
            x["i"],
        ),
    )
    found = found.withColumn("repeats", F.sort_array(F.filter(beside, lambda i: i.isNotNull())))
    n = F.size("repeats") - 1
    gaps = F.zip_with(
        F.slice("repeats", F.lit(1), n), F.slice("repeats", F.lit(2), n), lambda x, y: F.least(F.lit(WINDOW), y - x)
    )
    covered = WINDOW + F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_distinct": F.size(F.array_distinct("h")),
        "n_upper": F.regexp_count("text", F.lit("[A-Z]")),
        "n_marks": F.regexp_count("text", F.lit("[!?;:/=(){}\\[\\]0-9]")),
        "n_lines": F.size("lines"),
    }
    return found.select("doc_id", *[counts[k].cast("long").alias(k) for k in COUNTS])


def failed() -> Column:
    """The base rule: too few words, or too many in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "distinct_words": F.col("n_distinct") / words,
        "upper_case": F.col("n_upper") / chars,
        "marks": F.col("n_marks") / chars,
        "line_words": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are bad; covered and bad are counts where it was pruned."""

    conditions: tuple[Condition, ...]
    covered: int
    bad: int

    def column(self) -> Column:
        return reduce(lambda x, y: x & y, [c.column() for c in self.conditions])


def verdict(rules: list[Rule]) -> Column:
    """True for what no rule calls bad, over the columns of `features`."""
    chain = None
    for rule in rules:
        met = F.coalesce(rule.column(), F.lit(False))
        chain = F.when(met, False) if chain is None else chain.when(met, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best(rows: list, thresholds: dict[str, list[float]], least: int) -> tuple | None:
    """The condition with the largest gain, from counts per feature and bin."""
    best = None
    for feature, cuts in thresholds.items():
        table = {r["bin"]: r for r in rows if r["feature"] == feature}
        total = {k: sum(r[k] for r in table.values()) for k in ("bad", "good", "bad_p", "good_p")}
        below = dict.fromkeys(total, 0)
        for k, threshold in enumerate(cuts):
            if k in table:
                below = {x: below[x] + table[k][x] for x in below}
            for above in (True, False):
                side = {x: total[x] - below[x] if above else below[x] for x in total}
                if side["bad"] + side["good"] < least:
                    continue
                gain = _gain(side["bad"], side["good"], total["bad"], total["good"])
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, Condition(feature, above, threshold), side
    return best


def _bin(name: str, cuts: list[float]) -> Column:
    """How many thresholds lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda t: t < F.col(name)))


def learn(
    labelled: DataFrame,
    names: list[str],
    bins: int = 24,
    most_rules: int = 10,
    most_conditions: int = 4,
    least: int = 5,
    precision: float = 0.85,
) -> list[Rule]:
    """Rules for `bad` (boolean) over the double columns `names` of `labelled`, which has doc_id.

    Two thirds of the rows, by a hash of doc_id, grow the rules, the others prune them. A rule counts if
    at least the share `precision` of what it covers among the latter is bad. `most_rules` and
    `most_conditions` bound the size of the list, not the rows. Thresholds are quantiles. No rows,
    or one class, give an empty list.
    """
    cuts = labelled.agg(
        *[F.percentile_approx(k, [i / bins for i in range(1, bins)], 2000).alias(k) for k in names]
    ).first()
    thresholds = {k: sorted(set(cuts[k] or [])) for k in names}
    grows = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(3)) > 0
    binned = labelled.select(
        "bad",
        grows.alias("grows"),
        *names,
        F.array(
            *[
                F.struct(F.lit(k).alias("feature"), _bin(k, thresholds[k]).alias("bin"))
                for k in names
            ]
        ).alias("bins"),
    )
    binned = cut(binned)
    count = lambda which: F.sum(F.when(which, 1).otherwise(0))
    bad, part = F.col("bad"), F.col("grows")
    sums = [
        count(bad & part).alias("bad"),
        count(~bad & part).alias("good"),
        count(bad & ~part).alias("bad_p"),
        count(~bad & ~part).alias("good_p"),
    ]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = binned.filter(verdict(rules))
        conditions: list[Condition] = []
        trail: list[tuple[int, int]] = []
        while len(conditions) < most_conditions:
            rows = left
            for c in conditions:
                rows = rows.filter(c.column())
            counts = rows.select("bad", "grows", F.inline("bins")).groupBy("feature", "bin").agg(*sums).collect()
            found = _best(counts, thresholds, least)
            if found is None:
                break
            _, condition, side = found
            conditions.append(condition)
            trail.append((side["bad_p"], side["good_p"]))
            if not side["good"]:
                break
        if not conditions:
            break
        worth = [(b - g) / (b + g) if b + g >= 2 else -1.0 for b, g in trail]
        at = max(range(len(worth)), key=lambda k: (worth[k], -k))
        b, g = trail[at]
        if b + g < 2 or b < precision * (b + g):
            break
        rules.append(Rule(tuple(conditions[: at + 1]), b + g, b))
    return rules


def quality_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and `bad` of documents with one quality label; contradicting labels count as none."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("q"), F.max("quality").alias("other")).filter("q = other")
    named = [v.alias(k) for k, v in features().items()]
    return stats.join(known.select("doc_id", "q"), "doc_id").select("doc_id", *named, (F.col("q") == 0).alias("bad"))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of `documents` (doc_id, text).

    Rules are learnt from rows that the base rule lets pass. Rows with a null id or text are judged like
    others and aren't learnt from where they have no label. An empty table gives no rows.
    """
    stats = cut(statistics(documents))
    rules = learn(quality_rows(stats.filter(~failed()), labels), list(features()))
    named = stats.select("*", *[v.alias(f"_{k}") for k, v in features().items()])
    renamed = [Rule(tuple(Condition(f"_{c.feature}", c.above, c.threshold) for c in r.conditions), r.covered, r.bad) for r in rules]
    return named.select("doc_id", *COUNTS, failed().alias("base_failed"), (~failed() & verdict(renamed)).alias("kept"))
