"""Near-duplicate documents by a chosen-path similarity join.

Documents with equal shingle sets are one vertex. In every tree all vertices start in one node; a
node that is not small is branched: a hash of the node chooses minwise tokens, and its vertices go
to the child of the value they have there, so that similar sets follow the same paths. Small nodes
are compared exhaustively on their sketches; what is still large after the last level is split into
blocks, and every pair of blocks is compared. Independent trees are repeated until the chance that
a pair at the threshold meets nowhere is below the target. The sketches' links only say which sets
have to meet: links themselves are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_groups
from kindred.llm.components import components
from kindred.session import broadcast_if_fits, cut_lineage, spread_width

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_MEMBER_BYTES = 80
_ROW_BYTES = 24
_SKETCH = "doc_id long, mark long, n_shingles long, vid binary, sketch binary"
LAST = (1 << 63) - 1  # the key of null ids: after all others


@dataclass(frozen=True)
class Join:
    """Parameters: link sets with 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 85
    hashes: int = 64
    recall: float = 0.99999
    small: int = 2048
    draws: int = 2
    levels: int = 2
    block_sets: int = 256
    block_shingles: int = 1_000_000
    seed: int = 11

    @property
    def trees(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.percent / 100)))

    @property
    def least_equal(self) -> int:
        """Equal minima below which a sketch is 4.5 standard deviations short of the threshold."""
        s = self.percent / 100
        return max(1, math.floor(self.hashes * (s - 4.5 * math.sqrt(s * (1 - s) / self.hashes))))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as a-z."""
    found = _WORDS.findall(text.encode().lower()) if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(sets: np.ndarray, join: Join) -> bytes:
    rng = np.random.default_rng(join.seed)
    a = rng.integers(1, 1 << 63, join.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, join.hashes, dtype=np.uint64)
    best = np.full(join.hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        best = np.minimum(best, (np.multiply.outer(sets[at : at + 2048], a) + b).min(axis=0))
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """``doc_id``, mark of the text, set size, set id and sketch of every row; without words the last two are null."""
    fields = [("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("vid", pa.binary()), ("sketch", pa.binary())]
    target = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, marks = [], [], []
            for text in batch.column(2):
                h = shingles(text.as_py(), join.words)
                sizes.append(len(h))
                ids.append(set_id(h) if len(h) else None)
                marks.append(minima(h, join) if len(h) else None)
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(docs).alias("mark"), "text").mapInArrow(run, _SKETCH)


def id_key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def text_mark(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what ``linked`` connects: a search that never looks again at a vertex it has reached."""
    free, edges = np.arange(n), []
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            at = queue.pop()
            hit = linked(at, free)
            edges += [(at, int(i)) for i in free[hit]]
            queue += free[hit].tolist()
            free = free[~hit]
    return edges


def link_columns(vids: list[bytes], edges: list[tuple[int, int]]) -> dict[str, list] | None:
    return {"a": [vids[i] for i, _ in edges], "b": [vids[j] for _, j in edges]} if edges else None


def in_blocks(rows: DataFrame, key: str, blocks: F.Column) -> DataFrame:
    """``rows`` with ``p, q``: every pair of the ``blocks`` blocks of a key, each row in the pairs of its block."""
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    paired = own.withColumn("other", other)
    # With several blocks a block need not meet itself: every pair of blocks compares both wholly.
    met = (F.col("blocks") == 1) | (F.col("own") != F.col("other"))
    return paired.where(met).select(
        *rows.columns, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    )


def candidate_links(vertices: DataFrame, join: Join) -> DataFrame:
    """Links of sketches that connect every pair which some tree brings together."""
    rng = np.random.default_rng(join.seed + 1)
    places = rng.choice(join.hashes, min(join.trees, join.hashes), replace=False)

    def token(place: F.Column | int) -> F.Column:
        start = F.lit(int(place) * 4 + 1) if not isinstance(place, F.Column) else place * 4 + 1
        return F.substr("sketch", start, F.lit(4))

    def counted(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        return cut_lineage(rows.join(sizes, "node"))

    roots = F.array(*[F.xxhash64(F.lit(t), token(p)) for t, p in enumerate(places)])
    nodes = counted(vertices.select("vid", F.explode(roots).alias("node")))
    marks = vertices.select("vid", "sketch")
    leaves = []
    for _ in range(join.levels):
        large = nodes.where(F.col("n") > join.small)
        leaves.append(nodes.where(F.col("n") <= join.small))
        if large.isEmpty():
            nodes = large
            break
        children = F.array(
            *[F.xxhash64("node", F.lit(d), token(F.pmod(F.xxhash64("node", F.lit(d)), F.lit(join.hashes)).cast("int"))) for d in range(join.draws)]
        )
        nodes = counted(large.drop("n").join(marks, "vid").select("vid", F.explode(children).alias("node")))
    leaves.append(nodes)
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)

    def compare(group: pa.Table) -> dict[str, list] | None:
        found = dict(zip(group.column("vid").to_pylist(), group.column("sketch").to_pylist(), strict=True))
        vids = sorted(found)
        marks = np.frombuffer(b"".join(found[v] for v in vids), "<u4").reshape(len(vids), -1)
        return link_columns(vids, spanning(len(vids), lambda i, free: (marks[free] == marks[i]).sum(axis=1) >= join.least_equal))

    half = join.small / 2
    met = in_blocks(every, "node", F.when(F.col("n") <= join.small, 1).otherwise(F.ceil(F.col("n") / half)))
    return map_groups(met.join(marks, "vid"), ["node", "p", "q"], compare, "a binary, b binary")


def confirmed_links(docs: DataFrame, members: DataFrame, join: Join, repeated: bool = False) -> DataFrame:
    """Links on full sets that connect all linked members of each cluster; ``repeated``: a member may be many rows.

    ``members``: ``id, mark, vid, cluster, n_shingles``. Only members' texts are read into sets.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / join.block_sets), F.ceil(F.col("s") / join.block_shingles))
    blocked = members.join(sizes, "cluster").withColumn("blocks", F.when(F.col("n") <= 2, 1).otherwise(blocks))
    wanted = broadcast_if_fits(blocked.select("id", "mark", "vid", "cluster", "blocks"), _MEMBER_BYTES)
    texts = docs.select(id_key(docs).alias("id"), text_mark(docs).alias("mark"), "text").join(wanted, ["id", "mark"])
    if repeated:
        texts = texts.dropDuplicates(["vid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vids, clusters, blocks, sets = [], [], [], []
            for text, vid, cluster, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingles(text, join.words)
                if set_id(h) == vid:  # a repeated id may stand for another text
                    vids.append(vid), clusters.append(cluster), blocks.append(n), sets.append(h.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"vid": vids, "cluster": clusters, "blocks": blocks, "hashes": sets},
                schema=pa.schema([("vid", pa.binary()), ("cluster", pa.binary()), ("blocks", pa.int64()), ("hashes", pa.binary())]),
            )

    dealt = texts.select("text", "vid", "cluster", F.col("blocks").cast("long").alias("blocks")).repartition(
        spread_width(docs), F.xxhash64("vid")
    )
    sets = dealt.mapInArrow(run, "vid binary, cluster binary, blocks long, hashes binary").withColumnRenamed("blocks", "b")

    def compare(group: pa.Table) -> dict[str, list] | None:
        found = dict(zip(group.column("vid").to_pylist(), group.column("hashes").to_pylist(), strict=True))
        vids = sorted(found)
        own = [np.frombuffer(found[v], np.uint64) for v in vids]
        sizes = np.array([len(x) for x in own])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        names, flat = np.unique(np.concatenate(own), return_inverse=True)

        def linked(i: int, free: np.ndarray) -> np.ndarray:
            mark = np.zeros(len(names), np.int64)
            mark[flat[starts[i] : ends[i]]] = 1
            near = np.minimum(sizes[free], sizes[i]) * 100 >= join.percent * np.maximum(sizes[free], sizes[i])
            hit = np.zeros(len(free), bool)
            if near.any():
                both = np.array([mark[flat[starts[j] : ends[j]]].sum() for j in free[near]])
                hit[near] = 100 * both >= join.percent * (sizes[free[near]] + sizes[i] - both)
            return hit

        return link_columns(vids, spanning(len(vids), linked))

    met = in_blocks(sets, "cluster", F.col("b")).drop("b")
    return map_groups(met, ["cluster", "p", "q"], compare, "a binary, b binary")


def labels_of(docs: DataFrame, every: DataFrame, join: Join, null_ids: bool, repeated: bool = False) -> DataFrame:
    """``vid, first`` of the sets that several rows share or that are linked.

    ``first`` (``id, mark``) stands for the component: its smallest id, and the smallest mark of a
    text among the rows with that id. ``null_ids``: sets that only null ids have take part as well.
    """
    vertices = (
        every.where(F.col("vid").isNotNull())
        .groupBy("vid")
        .agg(
            F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "mark")).alias("own"), F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"),
        )
    )
    vertices = cut_lineage(vertices if null_ids else vertices.where(F.col("doc_id").isNotNull()))
    clusters = components(candidate_links(vertices, join))
    members = cut_lineage(
        vertices.join(clusters.withColumnRenamed("v", "vid"), "vid").select("own.*", "vid", F.col("root").alias("cluster"), "n_shingles")
    )
    linked = components(confirmed_links(docs, members, join, repeated)).withColumnRenamed("v", "vid")
    joined = vertices.where("copies > 1").select("vid").unionByName(linked.select("vid")).distinct()
    labelled = vertices.select("vid", "own").join(joined, "vid").join(linked, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    least = labelled.groupBy("root").agg(F.min("own").alias("first"))
    return cut_lineage(labelled.join(least, "root").select("vid", "first"))


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest id that links lead to; ``kept`` marks the row that has it. A
    text without words has an empty set and is linked with nothing. Rows that repeat an id are one
    document. A null id has no component of its own and is kept unless its set equals another
    document's, whose component it then shows; it starts no links. Other columns are ignored;
    no rows give no rows.
    """
    every = cut_lineage(sketches(docs, join))
    labels = labels_of(docs, every, join, null_ids=False).select("vid", F.col("first.id").alias("component_id"))
    shown = every.drop("sketch", "mark").join(broadcast_if_fits(labels, _MEMBER_BYTES), "vid", "left")
    component = F.coalesce("component_id", "doc_id")
    return shown.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == component).alias("kept"),
    )


def keep_one(docs: DataFrame, join: Join = Join(), repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` whose text stands for its component, with their columns as they are.

    Rows are told apart by id and text. A null id comes after all others, is linked like any other,
    and one row of a component stays. Rows that repeat an id and its text are one document and stay
    together; without ``repeats`` one of them stays, the one with the smallest hash of its columns.
    Texts without words stay.
    """
    every = cut_lineage(sketches(docs, join))
    rows = every.where(F.col("vid").isNotNull()).select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "mark", "vid")
    again = cut_lineage(rows.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("id", "mark"))
    repeated = not again.isEmpty()
    labels = labels_of(docs, every, join, null_ids=True, repeated=repeated)
    shown = rows.join(broadcast_if_fits(labels, _MEMBER_BYTES), "vid")
    stands = (F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    gone = cut_lineage(shown.where(~stands).select("id", "mark").distinct())

    def meets(side: DataFrame) -> Column:
        return (id_key(docs) == side["id"]) & (text_mark(docs) == side["mark"])

    kept = docs.join(broadcast_if_fits(gone, _ROW_BYTES), meets(gone), "left_anti")
    if not repeated:
        return kept
    once = again.join(gone, ["id", "mark"], "left_anti")
    once = cut_lineage(once.where(F.col("id") == LAST) if repeats else once)
    side = broadcast_if_fits(once, _ROW_BYTES)
    columns = [docs[c] for c in docs.columns]
    one = (
        docs.join(side, meets(once), "left_semi")
        .select(id_key(docs).alias("id"), text_mark(docs).alias("mark"), F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("place"))
        .groupBy("id", "mark")
        .agg(F.min_by("row", "place").alias("row"))
    )
    return kept.join(side, meets(once), "left_anti").unionByName(one.select("row.*"))
