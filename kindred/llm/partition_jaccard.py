"""Exact Jaccard self-join of shingle sets by partitioning the universe.

Documents with equal sets are one class. Sizes are cut into bands; in a band all tokens are hashed
into segments, so that two similar sets, which differ in at most ``d`` tokens, agree wholly on one of
any ``d + 1`` segments. Two neighbouring segments may instead be merged and matched with up to one
differing token, by the merged segment and its one-deletion neighbours: that covers as much as the
two, with more keys and fewer chance meetings. Costs counted over all classes decide for every pair
of segments of the bands of short sets, and the order in which pairs are used. A set is filed in its own
band and, if it may be the larger one of a pair, in the band below.

Rows that meet at a key of few rows are compared by size and by parity bits, which bound the number
of differing tokens from below and so lose no pair; rows of a frequent key are joined to its smallest
row. The groups that arise only say which sets have to meet: every pair in a group is decided on full
sets, block by block, unless it is connected already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_groups
from kindred.llm.components import components
from kindred.llm.minhash_paths import id_key, in_blocks, link_columns, set_id, shingles, spanning, text_mark
from kindred.session import broadcast_if_fits, cut_lineage, spread_width

_PARITY_WORDS = 8
_FEW = 8
# Segments with fewer tokens are passed over: many sets share them by chance.
_STRONG = 3
_ROW_BYTES = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = 256


@dataclass(frozen=True)
class Join:
    """Parameters: link sets with 100 * intersection >= percent * union."""

    words: int = 3
    percent: int = 90
    band_ratio: float = 1.5
    costed_segments: int = 32
    key_cost: float = 1.0  # of one key
    pair_cost: float = 4.0  # of one pair of rows that meet at a key
    block_sets: int = 256
    block_shingles: int = 1_000_000

    def differing(self, smaller: int, larger: int) -> int:
        """The most tokens in which linked sets of these sizes differ."""
        return (100 - self.percent) * (smaller + larger) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def allowance(self, size: int) -> int:
        """The most tokens in which a set of this size and a linked one that is not smaller differ."""
        return self.differing(size, self.largest_partner(size))

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(self.band_ratio) + 1e-9)

    @cache
    def band_sizes(self, band: int) -> tuple[int, int]:
        """The smallest and largest size of a band; the first is larger where the band is empty."""
        low = max(1, math.ceil(self.band_ratio**band - 1e-6))
        while low > 1 and self.band(low - 1) >= band:
            low -= 1
        while self.band(low) < band:
            low += 1
        high = low
        step = max(1, math.ceil(self.band_ratio ** (band + 1)) - low + 2)
        while step:
            if self.band(high + step) <= band:
                high += step
            else:
                step //= 2
        return low, high

    @cache
    def segments(self, band: int) -> int:
        """Segments of a band: an even number, a quarter more than its largest sets need."""
        needed = self.allowance(self.band_sizes(band)[1]) + 1
        return (needed + (needed - 1) // 4 + 1) // 2 * 2

    @cache
    def bands_of(self, size: int) -> list[tuple[int, int]]:
        """``(band, needed)``: the bands where a set is filed, and what its segments have to cover there."""
        own = self.band(size)
        found = [(own, self.allowance(size) + 1)]
        for band in range(own - 1, -1, -1):
            low, high = self.band_sizes(band)
            if low <= high:
                if self.largest_partner(high) < size:
                    break
                found.append((band, self.allowance(high) + 1))
        return found


@dataclass
class Allocation:
    """For each costed band its merged segments in order: ``(pair of segments, merged?)``; others go in natural order."""

    bands: dict[int, list[tuple[int, bool]]] = field(default_factory=dict)

    def merges(self, band: int) -> bool:
        return any(merged for _, merged in self.bands.get(band, []))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(31))


def segment_keys(h: np.ndarray, band: int, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The xor of every segment's mixed tokens, and the segment of each token."""
    m = join.segments(band)
    at = (mixed(h ^ np.uint64(band + 1)) >> np.uint64(32)) % np.uint64(m)
    keys = np.zeros(m, np.uint64)
    np.bitwise_xor.at(keys, at, mixed(h))
    return keys, at


def parity(h: np.ndarray) -> np.ndarray:
    """Parity bits of the tokens' hashes: sets differ in at least as many tokens as bits."""
    at = (mixed(h) >> np.uint64(20)) % np.uint64(64 * _PARITY_WORDS)
    bits = np.bincount(at.astype(np.int64), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def tagged(values: np.ndarray, band: int, place: np.ndarray | int, level: int) -> np.ndarray:
    """Keys of different bands, segments and levels (0: one segment, 1: two merged) never stand for each other."""
    salt = mixed(np.atleast_1d(np.asarray(place, np.uint64)) * np.uint64(4) + np.uint64((band << 40) + level + 1))
    return mixed(values ^ salt).view(np.int64)


def prefix_keys(keys: np.ndarray, tokens: np.ndarray, band: int, needed: int) -> np.ndarray:
    """Keys of the first segments with at least ``_STRONG`` tokens, as many as needed; of all where they are too few.

    Of two similar sets the one that stops first has ``needed`` such segments up to there. One of
    them is equal in both sets, so the other one has filed it as well.
    """
    strong = np.flatnonzero(tokens >= _STRONG)[:needed]
    places = strong if len(strong) == needed else np.arange(len(keys))
    return tagged(keys[places], band, places, 0)


_SETS = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("vid", pa.binary()),
    ("bits", pa.list_(pa.int64())), ("keys", pa.binary()), ("segments", pa.binary()),
])


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """Size, set id, parity bits and keys of every row; without words the last four are null.

    ``keys`` are those of the bands that are not costed. ``segments`` holds, for each costed band,
    the values of all segments and then a byte each that tells whether it has tokens enough. Sets so
    small that only an equal one can be linked have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                h = shingles(text.as_py(), join.words)
                if not len(h):
                    rows.append((0, None, None, None, None))
                    continue
                final, costed = [], []
                for band, needed in join.bands_of(len(h)) if join.allowance(len(h)) else []:
                    values, at = segment_keys(h, band, join)
                    tokens = np.bincount(at.astype(np.int64), minlength=len(values))
                    if len(values) > join.costed_segments:
                        final.append(prefix_keys(values, tokens, band, needed).tobytes())
                    else:
                        costed += [values.tobytes(), (tokens >= _STRONG).astype(np.uint8).tobytes()]
                rows.append((len(h), set_id(h), parity(h), b"".join(final), b"".join(costed)))
            columns = [*batch.columns[:2], *(pa.array(x, f.type) for x, f in zip(columns_of(rows, 5), list(_SETS)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(docs).alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, vid binary, bits array<long>, keys binary, segments binary")


def columns_of(rows: list[tuple], width: int) -> list:
    return list(zip(*rows)) if rows else [[]] * width


def costed(n: int, segments: bytes, join: Join) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(band, needed, values, strong)`` of a set's costed bands as ``sets_of`` wrote them."""
    start = 0
    for band, needed in join.bands_of(n) if segments else []:
        m = join.segments(band)
        if m <= join.costed_segments:
            values = np.frombuffer(segments, np.uint64, m, start)
            yield band, needed, values, np.frombuffer(segments, np.uint8, m, start + 8 * m).astype(bool)
            start += 9 * m


def segment_costs(classes: DataFrame, join: Join) -> DataFrame:
    """Rows, tokens and expected meetings of every segment of the costed bands, single and merged, over all classes.

    Rows are counted by 256 buckets of their key; the sum of squares beyond what chance spreads over
    the buckets tells how many rows share a key. At most a few thousand rows result.
    """
    schema = pa.schema([("band", pa.int32()), ("place", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], np.ndarray] = {}
        tokens: dict[int, list[int]] = {}
        for batch in batches:
            for n, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for band, _, values, strong in costed(n, segments, join):
                    of_band = tokens.setdefault(band, [0])
                    of_band[0] += n
                    for level, keys in ((0, values), (1, values[0::2] ^ values[1::2])):
                        buckets = (mixed(keys ^ _MIX) >> np.uint64(40)) % np.uint64(_BUCKETS)
                        for place, bucket in enumerate(buckets.tolist()):
                            if level or strong[place]:
                                counts.setdefault((band, place, level), np.zeros(_BUCKETS, np.int64))[bucket] += 1
        rows = [(b, p, v, int(i), int(c[i]), 0) for (b, p, v), c in counts.items() for i in np.flatnonzero(c)]
        rows += [(b, -1, 0, 0, 0, t[0]) for b, t in tokens.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns_of(rows, 6), schema)], schema=schema)

    counted = classes.select("n_shingles", "segments").mapInArrow(
        run, "band int, place int, level int, bucket int, n long, tokens long"
    )
    by_bucket = counted.groupBy("band", "place", "level", "bucket").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    n = F.col("n").cast("double")
    return by_bucket.groupBy("band", "place", "level").agg(
        F.sum(n).alias("rows"), F.sum(n * n).alias("squares"), F.sum("tokens").alias("tokens")
    )


def allocate(costs: DataFrame, join: Join) -> Allocation:
    """The cheaper of two single segments and one merged, for every pair of segments; cheap pairs first."""
    meets: dict[tuple[int, int, int], tuple[float, float]] = {}
    tokens: dict[int, float] = {}
    for r in costs.collect():
        if r["place"] < 0:
            tokens[r["band"]] = r["tokens"]
        else:
            chance = r["rows"] + r["rows"] ** 2 / _BUCKETS
            meets[r["band"], r["place"], r["level"]] = (r["rows"], max(0.0, r["squares"] - chance) / 2)
    out = Allocation()
    for band in sorted(tokens):
        choices = []
        for j in range(join.segments(band) // 2):
            rows, merged = meets.get((band, j, 1), (0.0, 0.0))
            single = sum(meets.get((band, 2 * j + i, 0), (0.0, 0.0))[1] for i in (0, 1))
            apart = 2 * join.key_cost * rows + join.pair_cost * single
            width = tokens[band] / max(1.0, rows) * 2 / join.segments(band)
            together = join.key_cost * rows * (1 + width) + 2 * join.pair_cost * merged
            choices.append((min(apart, together), j, together < apart))
        out.bands[band] = [(j, merged) for _, j, merged in sorted(choices)]
    return out


def chosen(order: list[tuple[int, bool]], needed: int, strong: np.ndarray) -> tuple[list[tuple[int, bool]], bool]:
    """The first pairs of segments that cover ``needed``, and whether segments with few tokens count as well.

    A merged pair covers two, a single segment one if it has tokens enough.
    """
    covered = 0
    for i, (j, merged) in enumerate(order):
        covered += 2 if merged else int(strong[2 * j]) + int(strong[2 * j + 1])
        if covered >= needed:
            return order[: i + 1], False
    return order, True


def exact_keys(segments: bytes, n: int, join: Join, allocation: Allocation) -> list[np.ndarray]:
    """Keys of the segments of a set's costed bands, whole; of merged ones as well."""
    out = []
    for band, needed, values, strong in costed(n, segments, join):
        pairs, every = chosen(allocation.bands[band], needed, strong)
        for j, merged in pairs:
            if merged:
                out.append(tagged(values[2 * j : 2 * j + 1] ^ values[2 * j + 1 : 2 * j + 2], band, j, 1))
            else:
                places = np.array([i for i in (2 * j, 2 * j + 1) if every or strong[i]], np.int64)
                out.append(tagged(values[places], band, places, 0))
    return out


def deletion_keys(h: np.ndarray, join: Join, allocation: Allocation) -> list[np.ndarray]:
    """Keys of the merged segments with one token left out."""
    out = []
    for band, needed in join.bands_of(len(h)):
        if not allocation.merges(band):
            continue
        values, at = segment_keys(h, band, join)
        strong = np.bincount(at.astype(np.int64), minlength=len(values)) >= _STRONG
        for j, merged in chosen(allocation.bands[band], needed, strong)[0]:
            if merged:
                inside = h[(at // np.uint64(2)) == np.uint64(j)]
                out.append(tagged((values[2 * j] ^ values[2 * j + 1]) ^ mixed(inside), band, j, 1))
    return out


_ENTRY = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("whole", pa.bool_())])


def entries(docs: DataFrame, classes: DataFrame, join: Join, allocation: Allocation, repeated: bool) -> DataFrame:
    """``key, c, whole``: what each class is filed under; ``whole`` is false for one-deletion neighbours."""

    def batch_of(keys: list[np.ndarray], owners: list[tuple[int, int]], whole: bool) -> pa.RecordBatch:
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        ids = np.repeat(np.array([c for c, _ in owners], np.int64), [n for _, n in owners]) if owners else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids), pa.array(np.full(len(flat), whole))], schema=_ENTRY)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for c, n, final, segments in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = [np.frombuffer(final, np.int64), *exact_keys(segments, n, join, allocation)]
                keys += own
                owners.append((c, sum(map(len, own))))
            yield batch_of(keys, owners, True)

    found = classes.select("c", "n_shingles", "keys", "segments").mapInArrow(exact, "key long, c long, whole boolean")
    merging = [b for b in allocation.bands if allocation.merges(b)]
    if not merging:
        return found

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for text, vid, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = shingles(text, join.words)
                if set_id(h) != vid:  # a repeated id may stand for another text
                    continue
                own = deletion_keys(h, join, allocation)
                keys += own
                owners.append((c, sum(map(len, own))))
            yield batch_of(keys, owners, False)

    largest = join.largest_partner(join.band_sizes(max(merging))[1])
    short = classes.where(F.col("n_shingles").between(join.band_sizes(min(merging))[0], largest)).select("id", "mark", "vid", "c")
    return found.unionByName(texts_of(docs, short, repeated).select("text", "vid", "c").mapInArrow(deleted, "key long, c long, whole boolean"))


def texts_of(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """The text of each row of ``wanted`` (``id``, ``mark``, ``vid``); ``repeated``: an id and its text may be many rows."""
    texts = docs.select(id_key(docs).alias("id"), text_mark(docs).alias("mark"), "text")
    found = texts.join(broadcast_if_fits(wanted, _ROW_BYTES), ["id", "mark"])
    return found.dropDuplicates(["vid"]) if repeated else found


def candidate_links(keyed: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Links ``a, b`` of classes that connect all that share a key and may be similar."""
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("whole"), F.col("c"))).alias("first"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
    )
    met = cut_lineage(keyed.join(shared, "key"))
    # Rows of frequent keys: each is linked to the smallest first row of its keys, and that to the keys' other first rows.
    many = met.where(F.col("n") > _FEW).select("c", "first")
    least = cut_lineage(many.groupBy("c").agg(F.min("first").alias("m")))
    stars = least.select(F.col("m").alias("a"), F.col("c").alias("b")).unionByName(
        many.join(least, "c").select(F.col("m").alias("a"), F.col("first").alias("b"))
    )
    few = met.where(F.col("n") <= _FEW).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "whole"))).alias("rows"))
    left, right = F.col("l"), F.col("r")
    pairs = (
        few.select("rows", F.explode("rows").alias("l"))
        .select("l", F.explode("rows").alias("r"))
        .where((left["c"] < right["c"]) & (left["whole"] | right["whole"]))
        .select(left["c"].alias("a"), right["c"].alias("b"))
        .distinct()
    )
    sides = [classes.select(F.col("c").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]
    compared = pairs.join(sides[0], "a").join(sides[1], "b")
    most = F.floor((100 - join.percent) * (F.col("n_a") + F.col("n_b")) / (100 + join.percent))
    differing = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in map(F.lit, range(_PARITY_WORDS))), F.lit(0))
    sized = 100 * F.least("n_a", "n_b") >= join.percent * F.greatest("n_a", "n_b")
    near = compared.where(sized & (differing <= most)).select("a", "b")
    return near.unionByName(stars.where("a <> b").distinct())


def confirmed_links(docs: DataFrame, members: DataFrame, join: Join, repeated: bool) -> DataFrame:
    """Links ``a, b`` of set ids that connect exactly the similar sets of each group, decided on full sets.

    ``members``: ``id, mark, vid, cluster, n_shingles``. A group is cut into blocks of bounded size.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / join.block_sets), F.ceil(F.col("s") / join.block_shingles))
    blocked = members.join(sizes, "cluster").withColumn("b", F.when(F.col("n") <= 2, 1).otherwise(blocks).cast("long"))
    wanted = blocked.select("id", "mark", "vid", "cluster", "b")
    texts = texts_of(docs, wanted, repeated).select("text", "vid", "cluster", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vid", pa.binary()), ("cluster", pa.int64()), ("b", pa.int64()), ("hashes", pa.binary())])
        for batch in batches:
            rows = []
            for text, vid, cluster, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = shingles(text, join.words)
                if set_id(h) == vid:
                    rows.append((vid, cluster, b, h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns_of(rows, 4), schema)], schema=schema)

    dealt = texts.repartition(spread_width(docs), F.xxhash64("vid"))
    sets = dealt.mapInArrow(run, "vid binary, cluster long, b long, hashes binary")

    def compare(group: pa.Table) -> dict[str, list] | None:
        found = dict(zip(group.column("vid").to_pylist(), group.column("hashes").to_pylist(), strict=True))
        vids = sorted(found)
        own = [np.frombuffer(found[v], np.uint64) for v in vids]
        sizes, marks = np.array([len(x) for x in own]), np.array([parity(x) for x in own])

        def linked(i: int, free: np.ndarray) -> np.ndarray:
            hit = 100 * np.minimum(sizes[free], sizes[i]) >= join.percent * np.maximum(sizes[free], sizes[i])
            apart = np.bitwise_count((marks[free] ^ marks[i]).view(np.uint64)).sum(axis=1)
            hit &= (100 + join.percent) * apart.astype(np.int64) <= (100 - join.percent) * (sizes[free] + sizes[i])
            for at in np.flatnonzero(hit):
                other = own[free[at]]
                both = len(own[i]) + len(other) - len(np.union1d(own[i], other))
                hit[at] = 100 * both >= join.percent * (len(own[i]) + len(other) - both)
            return hit

        return link_columns(vids, spanning(len(vids), linked))

    met = in_blocks(sets, "cluster", F.col("b")).drop("b")
    return map_groups(met, ["cluster", "p", "q"], compare, "a binary, b binary")


def similar(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest id that links lead to. A text without words has an empty set and
    is linked with nothing. Rows that repeat an id are one document. A null id has no component of
    its own; where its set equals or is linked through other documents' sets it shows theirs, and it
    starts no links. Other columns are ignored; no rows give no rows.
    """
    every = cut_lineage(sets_of(docs, join))
    repeated = not every.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    parts = [F.first(x).alias(x) for x in ("n_shingles", "bits", "keys", "segments")]
    grouped = every.where(F.col("vid").isNotNull()).groupBy("vid").agg(own.alias("own"), F.count("*").alias("rows"), *parts)
    named = grouped.where(F.col("own").isNotNull()).select(
        "vid", F.col("own.doc_id").alias("id"), F.col("own.mark").alias("mark"), "rows", "n_shingles", "bits", "keys", "segments"
    )
    classes = cut_lineage(named.withColumn("c", F.monotonically_increasing_id()))
    allocation = allocate(segment_costs(classes, join), join)
    groups = components(candidate_links(entries(docs, classes, join, allocation, repeated), classes, join))
    clusters = groups.select(F.col("v").alias("c"), F.col("root").alias("cluster"))
    members = cut_lineage(classes.join(clusters, "c").select("id", "mark", "vid", "cluster", "n_shingles"))
    linked = components(confirmed_links(docs, members, join, repeated)).withColumnRenamed("v", "vid")
    # Only sets that several rows share or that are linked have a label of their own.
    rooted = classes.select("vid", "id", "rows").join(linked, "vid", "left").where((F.col("rows") > 1) | F.col("root").isNotNull())
    rooted = rooted.select("vid", "id", F.coalesce("root", "vid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = cut_lineage(rooted.join(least, "root").select("vid", "component_id"))
    rows = every.select("doc_id", "n_shingles", "vid")
    shown = rows.where(F.col("vid").isNotNull()).join(broadcast_if_fits(labels, _ROW_BYTES), "vid", "left")
    alone = rows.where(F.col("vid").isNull()).withColumn("component_id", F.col("doc_id"))
    return shown.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(
        alone.select("doc_id", "n_shingles", "component_id")
    )
