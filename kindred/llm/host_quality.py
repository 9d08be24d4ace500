"""Quality rules whose failures are judged by host as well as by document.

A document's counts come from one pass over its text. Failures of each rule are summed by host;
a host's rate is shrunk towards a beta prior fitted to all hosts by the method of moments, so that
a host with few documents is judged like the average one. A host whose shrunk rate of a rule is
above that rule's limit is strict: its documents have to pass every rule.
Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WORD_GAP_CLASS, WORD_GAPS, let
from kindred.session import broadcast_if_fits, cut_lineage

HOST_BYTES = 400


@dataclass(frozen=True)
class Rules:
    """Document limits, and the share of failing documents that makes a host strict."""

    least_words: int = 50
    most_repeat_pct: int = 50
    most_symbols_per_word: float = 0.1
    most_dup_lines_pct: int = 30
    strict_share: float = 0.5


def _words(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WORD_GAPS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP_CLASS))


def _covered(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(windows: Column) -> Column:
        return F.filter(
            windows,
            lambda w, k: w["h"].eqNullSafe(F.get(windows, k - 1)["h"]) | w["h"].eqNullSafe(F.get(windows, k + 1)["h"]),
        )

    def union_of(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    starts = let(placed, lambda p: F.sort_array(F.transform(twice(p), lambda w: w["i"])))
    return let(starts, union_of)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every row.

    ``docs`` has ``doc_id``, ``text`` and ``host``. Lines without a word do not count. A null or
    empty text has zero everywhere.
    """
    words = docs.select("doc_id", "host", F.coalesce("text", F.lit("")).alias("text"), _words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(WORD_GAPS)) != "")
    hashed = words.select(
        "doc_id",
        "host",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        let(
            lines,
            lambda kept: F.struct(F.size(kept).alias("all"), (F.size(kept) - F.size(F.array_distinct(kept))).alias("dup")),
        ).alias("lines"),
        let(
            F.col("words"),
            lambda w: F.transform(
                F.slice(w, 3, F.greatest(F.size(w), F.lit(0))),
                lambda last, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), last),
            ),
        ).alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(
        _covered(F.col("windows"))
    )
    return hashed.select(
        "doc_id", "host", *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols")],
        F.col("lines.all").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def fail(measured: DataFrame, rules: Rules) -> DataFrame:
    """``measured`` with one boolean per rule: ``fails_short, fails_repeats, fails_symbols, fails_lines``."""
    return measured.withColumns(
        {
            "fails_short": F.col("n_words") < rules.least_words,
            "fails_repeats": 100 * F.col("n_repeat_words") > rules.most_repeat_pct * F.col("n_words"),
            "fails_symbols": F.col("n_symbols") > rules.most_symbols_per_word * F.col("n_words"),
            "fails_lines": 100 * F.col("n_dup_lines") > rules.most_dup_lines_pct * F.col("n_lines"),
        }
    )


FAILURES = ["fails_short", "fails_repeats", "fails_symbols", "fails_lines"]


def host_verdicts(failed: DataFrame, rules: Rules) -> DataFrame:
    """One row per host: documents, shrunk rate of each rule, and ``strict``.

    Prior of a rule: m is the share of failing documents, v the variance of the hosts' raw rates
    around m weighted by documents, less what chance alone gives (m (1 - m) hosts / documents).
    The beta prior has the weight w = m (1 - m) / v - 1, and never less than one document; the
    shrunk rate is (failures + w m) / (documents + w).
    """
    counts = failed.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.count_if(F.col(c)).alias(c) for c in FAILURES]
    )
    counts = cut_lineage(counts)
    totals = counts.agg(
        F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), *[F.sum(c).alias(c) for c in FAILURES],
        *[F.sum(F.col(c) * F.col(c) / F.col("n_docs")).alias(f"{c}_square") for c in FAILURES],
    ).first()  # one row of ten numbers
    rates = {}
    for c in FAILURES:
        docs = totals["docs"] or 1
        m = (totals[c] or 0) / docs
        spread = (totals[f"{c}_square"] or 0.0) / docs - m * m - m * (1 - m) * totals["hosts"] / docs
        weight = max(1.0, m * (1 - m) / spread - 1) if spread > 0 else 1.0
        rates[f"{c}_rate"] = (F.col(c) + F.lit(weight * m)) / (F.col("n_docs") + F.lit(weight))
    verdict = F.greatest(*[F.col(r) for r in rates]) > rules.strict_share
    return counts.select("host", "n_docs", *[r.alias(n) for n, r in rates.items()]).withColumn("strict", verdict)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, failures, ``base_failed``, the host's ``strict`` and ``kept`` of every row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``host``; other columns are ignored. ``kept`` is false
    where a base rule (too few words, too many repeated ones) fails, or any rule on a strict host.
    A null host is a host of its own; equal or null ``doc_id`` are rows of their own; no rows give
    no rows. The counts are written once, so texts are read once.
    """
    failed = cut_lineage(fail(measure(docs), rules))
    hosts = host_verdicts(failed, rules).select(F.col("host").alias("judged"), "strict")
    joined = failed.join(broadcast_if_fits(hosts, HOST_BYTES), F.col("host").eqNullSafe(F.col("judged")), "left")
    return finish(joined).drop("judged")


def finish(joined: DataFrame) -> DataFrame:
    base = F.col("fails_short") | F.col("fails_repeats")
    other = F.col("strict") & (F.col("fails_symbols") | F.col("fails_lines"))
    return joined.withColumns({"base_failed": base, "kept": ~base & ~F.coalesce(other, F.lit(False))})


def keep(docs: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are.

    The verdicts of hosts come from a first pass, those of documents from a second one: texts are
    not shuffled, and rows need no unique id.
    """
    shaped = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(shaped, "text", F.col(host).alias("host"))
    verdicts = host_verdicts(fail(measure(rows.select(F.lit(0).alias("doc_id"), "text", "host")), rules), rules)
    hosts = broadcast_if_fits(verdicts.select(F.col("host").alias("judged"), "strict"), HOST_BYTES)
    measured = fail(measure(rows.withColumnRenamed("row", "doc_id")), rules)
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("judged")), "left")
    return finish(joined).where("kept").select("doc_id.*")
