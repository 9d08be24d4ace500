"""Line dedup over a whole corpus: equal lines, and lines within a few edits of an earlier one.

Equal lines meet by digest. For the others, lines are cut into threshold + 1 segments: a line
within the threshold of another holds one of its segments unchanged, near the segment's place. So
every line is indexed by (length, segment number, segment) and probes, for each length it could
match, the substrings that may stand for each segment. Letter counts carried along drop most false
meetings inside the join; what is left is verified by a banded bit-parallel edit distance whose
words hold one bit per diagonal of the band. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WORD_GAPS, let
from kindred.session import broadcast_if_fits, cut_lineage

# Letters counted in each line, and how many of them by compiled code.
COUNTED = "etaonirshdlc"
COMPILED = 6
LAST = (1 << 63) - 1
_KEY_BYTES = 64


@dataclass(frozen=True)
class Near:
    """Lines of at least ``least_chars`` characters are near within ``edits`` edits; shorter ones only if equal."""

    edits: int = 2
    least_chars: int = 30


def _trimmed(raw: Column) -> Column:
    """``raw`` without gaps at its ends; a trim goes over the whole line, so only lines that have some are trimmed."""
    ends = [F.startswith(raw, F.lit(gap)) | F.endswith(raw, F.lit(gap)) for gap in WORD_GAPS]
    return F.when(reduce(or_, ends), F.trim(raw, F.lit(WORD_GAPS))).otherwise(raw)


def lines_of(docs: DataFrame) -> DataFrame:
    """``place`` (id, row mark, line number), ``line`` (trimmed) and its digest, for lines that hold something."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("doc_id", "text").alias("mark"), "text"
    )
    return (
        rows.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
        .withColumn("line", _trimmed(F.col("raw")))
        .where(F.col("line") != "")
        .select(F.struct("id", "mark", "at").alias("place"), "line", F.unhex(F.md5("line")).alias("digest"))
    )


def with_counts(sized: DataFrame) -> DataFrame:
    """``sized`` (``line``, its length ``n``) with ``counts``: occurrences of some letters modulo 32, five bits each.

    A letter is counted by what is lost when it is taken out, and the next one in what is left, so
    that the text gets shorter from letter to letter.
    """
    made, names = sized.withColumn("rest0", F.col("line")), sized.columns
    for i, letter in enumerate(COUNTED[:COMPILED]):
        sizes = [f"size{j}" for j in range(i)]
        left = F.replace(F.col(f"rest{i}"), F.lit(letter), F.lit(""))
        made = made.select(*names, *sizes, F.octet_length(f"rest{i}").alias(f"size{i}"), left.alias(f"rest{i + 1}"))
    made = made.withColumn(f"size{COMPILED}", F.octet_length(f"rest{COMPILED}"))
    total = F.lit(0).cast("long")
    for i in range(COMPILED):
        n = (F.col(f"size{i}") - F.col(f"size{i + 1}")).cast("long")
        total = total.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(31)), 5 * i))

    def other(place: Column) -> Column:
        left = F.replace(F.col(f"rest{COMPILED}"), F.substr(F.lit(COUNTED), place, F.lit(1)), F.lit(""))
        n = (F.col(f"size{COMPILED}") - F.octet_length(left)).cast("long").bitwiseAND(F.lit(31))
        return n * F.element_at(units, place)

    # A lambda on purpose: beside the keys, twelve compiled counts make a method too large for the JIT.
    units = F.array(*[F.lit(1 << 5 * i).cast("long") for i in range(len(COUNTED))])
    places = F.sequence(F.lit(COMPILED + 1), F.lit(len(COUNTED)))
    others = F.aggregate(F.transform(places, other), F.lit(0).cast("long"), lambda x, y: x + y)
    return made.select(*names, total.bitwiseOR(others).alias("counts"))


def _count_gap(a: Column, b: Column) -> Column:
    """Difference of packed counts; an edit changes at most two letter counts by one each."""
    total = F.lit(0)
    for i in range(len(COUNTED)):
        part = [F.shiftrightunsigned(x, 5 * i).bitwiseAND(F.lit(31)).cast("int") for x in (a, b)]
        gap = F.abs(part[0] - part[1])
        total = total + F.least(gap, F.lit(32) - gap)
    return total


def windows(edits: int) -> list[tuple[int, int, int]]:
    """``(less, segment, shift)`` of the substrings to look up, the line's own segments first.

    For a line that is ``less`` characters shorter: if segment i is the first one left unchanged, i
    edits at most lie before it and edits - i at most behind, so its place shifts by at most i, and
    by the lengths' difference less at most edits - i: the multi-match-aware window.
    """
    found = [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]
    return sorted(found, key=lambda w: (w[0] or w[2]) != 0)


def with_keys(sized: DataFrame, near: Near, *keep: str) -> DataFrame:
    """``sized`` (``line``, its length ``n``) with ``keys``: one per window, null outside the line.

    A key is made of the length and number of the segment that the substring may equal, and the
    substring. The first ``edits + 1`` are those of the line's own segments, under which it is
    indexed. Of the segments of a length the last ones are one longer where it does not come out
    even; that arithmetic is done once per length. Each key is an expression of its own, not a lambda
    over windows, so that it is compiled.
    """
    parts = near.edits + 1
    lengths = {}
    for less in range(parts):
        lengths[f"short{less}"] = F.call_function("div", F.col("n") - less, F.lit(parts)).cast("int")
        lengths[f"more{less}"] = (F.col("n") - less) % parts
    keys = []
    for less, i, shift in windows(near.edits):
        short, more = F.col(f"short{less}"), F.col(f"more{less}")
        at = short * i + F.greatest(F.lit(0), more - (parts - i)) + shift
        size = short + (more >= parts - i).cast("int")
        inside = (at >= 0) & (at + size <= F.col("n"))
        keys.append(F.when(inside, F.xxhash64(F.col("n") - less, F.lit(i), F.substr("line", at + 1, size))))
    return sized.withColumns(lengths).select(*keep, F.array(*keys).alias("keys"))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``.

    ``edits + 1`` words, one per number of errors, hold a bit per diagonal of the band; bit d says
    that the first j - edits + d characters of ``a`` match the first j of ``b``. A character of ``b``
    moves all diagonals at once; when no word has a bit left, the rest is passed over.
    """
    band = (1 << (2 * edits + 1)) - 1
    bits = [F.lit(1 << d) for d in range(2 * edits + 1)]

    def verdict(x: Column, y: Column) -> Column:
        start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)])

        def step(state: Column, j: Column) -> Column:
            char = F.get(y, j)
            match = F.lit(0)
            for d in range(2 * edits + 1):
                same = F.coalesce(F.get(x, j + (d - edits)) == char, F.lit(False))
                match = match.bitwiseOR(F.when(same & (j + (d - edits) >= 0), bits[d]).otherwise(0))

            def moved(m: Column) -> Column:
                rows: list[Column] = []
                for e in range(edits + 1):
                    row = state[f"r{e}"].bitwiseAND(m)
                    if e:
                        less = state[f"r{e - 1}"]
                        row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
                        row = row.bitwiseAND(F.lit(band))
                    rows.append(row)
                return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(rows)])

            return F.when(state[f"r{edits}"] == 0, state).otherwise(let(match, moved))

        final = F.size(x) - F.size(y) + edits
        over = F.aggregate(
            F.sequence(F.lit(0), F.size(y) - 1),
            start,
            step,
            lambda s: F.getbit(s[f"r{edits}"].cast("long"), F.greatest(F.lit(0), F.least(final, F.lit(2 * edits)))) == 1,
        )
        apart = F.abs(F.size(x) - F.size(y)) > edits
        return F.when(apart, F.lit(False)).otherwise(over)

    return let(F.split(a, ""), lambda x: let(F.split(b, ""), lambda y: verdict(x, y)))


def near_links(lines: DataFrame, near: Near) -> DataFrame:
    """Digests ``a, b`` of different lines within the threshold, each pair once."""
    n = F.length("line")
    # A copy of a line adds nothing: one row per line, before its keys are dealt out.
    sized = with_counts(
        lines.where(n >= near.least_chars).select("line", n.cast("int").alias("n"), F.xxhash64("line").alias("id"))
    )
    keyed = with_keys(sized, near, "id", "counts").groupBy("id").agg(F.first("keys").alias("keys"), F.first("counts").alias("counts"))
    places = windows(near.edits)
    same = F.array(*[F.lit(less == 0) for less, _, _ in places])  # the window looks for lines of the same length
    probe = keyed.select("id", "counts", F.posexplode("keys").alias("at", "key")).where(F.col("key").isNotNull())
    probe = probe.select("id", "counts", "key", F.get(same, F.col("at")).alias("same"))
    index = keyed.select("id", "counts", F.explode(F.slice("keys", 1, near.edits + 1)).alias("key"))
    i, p = index.alias("i"), probe.alias("p")
    # Lines of the same length would meet both ways.
    once = F.when(F.col("p.same"), F.col("i.id") < F.col("p.id")).otherwise(F.col("i.id") != F.col("p.id"))
    near_enough = _count_gap(F.col("i.counts"), F.col("p.counts")) <= 2 * near.edits
    met = i.join(p, (F.col("i.key") == F.col("p.key")) & once & near_enough)
    pairs = cut_lineage(met.select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = (
        lines.where(n >= near.least_chars)
        .select(F.xxhash64("line").alias("id"), "line")
        .join(broadcast_if_fits(wanted, 16), "id", "left_semi")
        .withColumn("digest", F.unhex(F.md5("line")))
        .dropDuplicates(["id", "digest"])
    )
    texts = cut_lineage(texts)
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"), F.col("digest").alias("digest_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("digest").alias("digest_b"))
    both = pairs.join(left, "a").join(right, "b")
    # Dealt anew: the check costs per character, so a few partitions of bytes are not a few tasks.
    spread = both.repartition(F.col("a"), F.col("b"))
    return spread.where(within(F.col("line_a"), F.col("line_b"), near.edits)).select(
        F.col("digest_a").alias("a"), F.col("digest_b").alias("b")
    )


def dropped_lines(docs: DataFrame, near: Near) -> DataFrame:
    """``id, mark`` of rows that lose lines, with the numbers of those lines (``equal``, ``near``)."""
    lines = lines_of(docs)
    # Written once, since texts take long to split: later steps need places and digests, not the lines.
    placed = cut_lineage(lines.select("place", "digest"))
    first = cut_lineage(placed.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    links = cut_lineage(near_links(lines, near))
    ends = links.select("a", "b").union(links.select("b", "a"))
    seen = first.select("digest", "first")
    later = (
        ends.join(seen.select(F.col("digest").alias("a"), F.col("first").alias("own")), "a")
        .join(seen.select(F.col("digest").alias("b"), F.col("first").alias("other")), "b")
        .where(F.col("other") < F.col("own"))
        .select(F.col("a").alias("digest"))
        .distinct()
        .withColumn("late", F.lit(True))
    )
    judged = first.join(broadcast_if_fits(later, _KEY_BYTES), "digest", "left").where("n > 1 OR late")
    judged = cut_lineage(judged.select("digest", "first", F.coalesce("late", F.lit(False)).alias("late")))
    gone = placed.join(broadcast_if_fits(judged, _KEY_BYTES), "digest").where(F.col("late") | (F.col("place") != F.col("first")))
    return (
        gone.select("place.id", "place.mark", "place.at", (F.col("place") != F.col("first")).alias("again"))
        .distinct()
        .groupBy("id", "mark")
        .agg(
            F.collect_list(F.when(F.col("again"), F.col("at"))).alias("equal"),
            F.collect_list(F.when(~F.col("again"), F.col("at"))).alias("near"),
        )
    )


def dedupe(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` with ``line_equal``, ``line_near`` (numbers of lines dropped) and ``line_text`` (what stays).

    Blank ends do not count. A line goes if an equal line, or one within ``near.edits`` edits, comes
    earlier: in a row with a smaller ``doc_id``, or above it in the same text; whether that one
    stays does not matter, so the result does not depend on an order of work. Lines without
    content stay. Columns of ``docs`` with the new names are replaced. Null ids come last, in an order fixed by a hash of the text; rows that repeat id
    and text are one row and are treated alike. A null text stays null; no rows give no rows.
    """
    gone = cut_lineage(dropped_lines(docs, near))
    # A row's list of line numbers is as long as its text has lines, so only short tables are broadcast.
    fits = gone.agg(F.sum(F.size("equal") + F.size("near") + 16).alias("n")).first()["n"] or 0
    side = F.broadcast(gone) if fits * 4 <= 16 * 1024 * 1024 else gone
    docs = docs.drop("line_equal", "line_near", "line_text", "line_id", "line_mark")
    keyed = docs.withColumns(
        {"line_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "line_mark": F.xxhash64("doc_id", "text")}
    )
    joined = keyed.join(side, (F.col("line_id") == side["id"]) & (F.col("line_mark") == side["mark"]), "left")
    empty = F.array().cast("array<int>")
    cut = joined.select(
        *[docs[c] for c in docs.columns],
        F.coalesce(F.sort_array(side["equal"]), empty).alias("line_equal"),
        F.coalesce(F.sort_array(side["near"]), empty).alias("line_near"),
    )
    lines = F.split(docs["text"], "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat("line_equal", "line_near"))
    rebuilt = let(lines, lambda all_lines: F.array_join(F.transform(stays, lambda i: F.get(all_lines, i)), "\n"))
    untouched = (F.size("line_equal") == 0) & (F.size("line_near") == 0)
    return cut.withColumn("line_text", F.when(untouched | F.col("text").isNull(), F.col("text")).otherwise(rebuilt))


def keep_lines(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``docs`` with the text that stays; a row that loses its last line with content goes as well."""
    cut = dedupe(docs, near)
    lost = (F.size("line_equal") + F.size("line_near") > 0) & (F.trim("line_text", F.lit(WORD_GAPS)) == "")
    return cut.where(~F.coalesce(lost, F.lit(False))).select(
        *[F.col("line_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    )
