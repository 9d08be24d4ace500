"""Lists for all users at once.

``recommend`` checks the size of the catalogue.  A small one is shipped to the tasks and
every user is served in one pass over the profiles, without a shuffle of scores.  One that a
task can hold but the driver should not is dealt to the tasks by a shuffle and serves in the
same way.  A larger one goes through ``blocks``, which joins users and item blocks by cell.
All are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import as_double, dot, l2_normalise
from kindred.operators import blocks, scan
from kindred.operators.profiles import matched_codes, user_profiles
from kindred.operators.selection import (
    SCORE_DIGITS,
    ListSpec,
    candidates,
    greedy_everywhere,
    greedy_picks,
    local_kmeans,
)
from kindred.session import BROADCAST_BYTES, cut_lineage, spread

RECOMMENDATION = (
    "user_id bigint, method string, pos int, item_id bigint, code string, section string, "
    "sim double, cluster bigint, score double"
)
SCORE_CHUNK = 4_000_000
FLUSH_ROWS = 50_000
# Above a threshold lie few items where less than this share of a sample does.
FEW = 0.05
# A catalogue that passes through the driver as arrays, and one that a task holds, are at most so large.
SHIPPED_BYTES = BROADCAST_BYTES // 4
DEALT_BYTES = 8 * BROADCAST_BYTES


@dataclass
class Catalogue:
    """A catalogue found small enough to ship, in ``item_id`` order."""

    item_id: np.ndarray
    code: np.ndarray
    section: np.ndarray
    vectors: np.ndarray
    cluster: np.ndarray | None
    group: np.ndarray

    def positions_by_code(self) -> dict[str, np.ndarray]:
        """Rows of each code; items without one belong to none."""
        known = np.flatnonzero(self.code != None)  # noqa: E711 - element by element
        order = known[np.argsort(self.code[known], kind="stable")]
        codes, starts = np.unique(self.code[order], return_index=True)
        return dict(zip(codes, np.split(order, starts[1:]), strict=True)) if len(codes) else {}

    def profile(self, taken: list[np.ndarray], raw: np.ndarray, dedupe: bool) -> np.ndarray:
        """Unit mean of the taken items' vectors; one item per code with ``dedupe``."""
        rows = np.concatenate([t[:1] for t in taken] if dedupe else taken)
        mean = raw[rows].mean(axis=0, dtype=np.float64)
        size = np.linalg.norm(mean)
        return mean / size if size > 0 else mean


def unit_items(items: DataFrame, metric: str = "cosine") -> DataFrame:
    """Item vectors as doubles, at unit length for the cosine."""
    vec = as_double(F.col("embedding"))
    return items.withColumn("embedding", l2_normalise(vec) if metric == "cosine" else vec)


def catalogue_bytes(items: DataFrame) -> int:
    """Bytes of a catalogue as arrays of doubles, strings included."""
    text = F.coalesce(F.octet_length("code"), F.lit(0)) + F.coalesce(F.octet_length("section"), F.lit(0))
    size = items.agg((F.sum(8 * F.size("embedding") + text) + 64 * F.count("*")).alias("bytes")).first()["bytes"]
    return size or 0


def catalogue_columns(items: DataFrame) -> list[str]:
    known = [c for c in ("cluster", "group_id") if c in items.columns]
    return ["item_id", "code", "section", "embedding", *known]


def shared_strings(column: pa.ChunkedArray) -> np.ndarray:
    """Strings as objects, equal ones only once in memory; None where there is none."""
    coded = column.combine_chunks().dictionary_encode()
    known = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
    return known[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def as_catalogue(table: pa.Table) -> Catalogue:
    """A table in ``item_id`` order as arrays; vectors keep their type."""
    names = table.column_names
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = table["item_id"].to_numpy()
    return Catalogue(
        item_id=ids,
        code=shared_strings(table["code"]),
        section=shared_strings(table["section"]),
        vectors=np.ascontiguousarray(flat.reshape(table.num_rows, -1)),
        cluster=table["cluster"].to_numpy() if "cluster" in names else None,
        group=table["group_id"].to_numpy() if "group_id" in names else ids,
    )


def small_catalogue(items: DataFrame, limit: int = SHIPPED_BYTES) -> Catalogue | None:
    """The catalogue as arrays, or None when it may exceed ``limit`` bytes."""
    if not limit or catalogue_bytes(items) > limit:
        return None
    return as_catalogue(items.select(*catalogue_columns(items)).toArrow().sort_by("item_id"))


def is_dealt(items: DataFrame, limit: int) -> bool:
    """Whether a task can hold the catalogue; nothing is, where ``limit`` is 0."""
    return limit > 0 and catalogue_bytes(items) <= max(limit, DEALT_BYTES)


def deal(
    items: DataFrame,
    rows: DataFrame,
    key: str,
    serve: Callable[[Catalogue, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``serve`` over the catalogue and a share of ``rows``, in twice as many tasks as cores.

    The items reach a task by the shuffle, before its rows and in ``item_id`` order: nothing of
    them passes through the driver, and no more copies are shuffled than there are tasks.
    """
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    fields = catalogue_columns(items)
    stock = items.select(*fields).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    asked = rows.select(
        F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int").alias("part"), F.lit(1).alias("asks"),
        *[F.col(c).alias(f"asked_{c}") for c in rows.columns],
    )
    both = stock.withColumn("asks", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    placed = both.repartitionById(tasks, "part").sortWithinPartitions("asks", "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        batches = iter(batches)
        first = None
        for batch in batches:
            n_items = batch.num_rows - int(batch.column("asks").to_numpy().sum())
            if n_items:
                held.append(batch.slice(0, n_items).select(fields))
            if n_items < batch.num_rows:
                first = batch.slice(n_items)
                break
        if first is None or not held:
            return
        # Nulls first is the order of the sort; a shipped catalogue has them last.
        table = pa.Table.from_batches(held)
        held.clear()
        blank = table["item_id"].null_count
        known = as_catalogue(pa.concat_tables([table.slice(blank), table.slice(0, blank)]) if blank else table)
        del table

        def shares() -> Iterator[pa.RecordBatch]:
            for batch in itertools.chain([first], batches):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f"asked_{c}") for c in rows_names], names=rows_names
                )

        yield from serve(known, shares())

    rows_names = list(rows.columns)
    return placed.mapInArrow(run, schema)


def unit_matrix(catalogue: Catalogue) -> np.ndarray:
    return blocks.unit_rows(catalogue.vectors.astype(np.float64))


def list_matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def score_chunks(
    batch: pa.RecordBatch, vectors: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, scores)`` of each user in a batch, a bounded block of users at a time."""
    profiles = list_matrix(batch.column("vec"))
    step = max(1, SCORE_CHUNK // max(1, len(vectors)))
    for start in range(0, len(profiles), step):
        block = np.round(profiles[start : start + step] @ vectors.T, SCORE_DIGITS)
        for i, sims in enumerate(block):
            yield start + i, sims


def server(
    specs: Sequence[ListSpec],
    metric: str = "cosine",
    dedupe_profile: bool = False,
    n_clusters: int = 10,
    seed: int = 42,
    counted: Sequence[str] = (),
) -> Callable[[Catalogue, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All lists of ``specs`` for users ``(user_id, codes)``, scores computed once.

    The catalogue in the tasks gives the profiles too, so of users nothing but ids is shuffled.
    """
    schema = pa.schema(
        [
            ("user_id", pa.int64()), ("method", pa.string()), ("pos", pa.int32()),
            ("item_id", pa.int64()), ("code", pa.string()), ("section", pa.string()),
            ("sim", pa.float64()), ("cluster", pa.int64()), ("score", pa.float64()),
            *([("n_keys", pa.int64())] if counted else []),
        ]
    )
    shown = [s for s in specs if s.method not in counted]
    numbers = [s for s in specs if s.method in counted]

    def key_counts(cat: Catalogue, stock: scan.Stock, keys: tuple, profiles: np.ndarray, taken: list[np.ndarray]):
        """``(row, method, number of different keys)`` of the lists that leave as a number."""
        key, held = keys
        left = {spec.method: np.arange(len(profiles)) for spec in numbers}
        for spec in numbers:
            # Most items are below the threshold: those above it and the taken ones are taken off.
            if spec.threshold is None or spec.cut is not None or spec.greedy or not stock.can(profiles):
                continue
            few = stock.share_above(profiles, spec.threshold) < FEW
            rows = np.flatnonzero(few)
            found = stock.above(profiles[rows], spec.threshold - stock.margin(profiles[rows])) if len(rows) else []
            for i, at in zip(rows, found, strict=True):
                gone = at[stock.exact(profiles[i], at) > spec.threshold]
                gone = np.union1d(gone, taken[i]) if spec.drops_first else gone
                lost, n = np.unique(key[gone], return_counts=True)
                yield i, spec.method, len(held) - int((n == held[lost]).sum())
            left[spec.method] = np.flatnonzero(~few)
        rest = np.unique(np.concatenate(list(left.values()))) if left else ()
        step = max(1, SCORE_CHUNK // max(1, stock.n))
        for start in range(0, len(rest), step):
            block = stock.similarities(profiles[rest[start : start + step]])
            for i, sims in zip(rest[start : start + step], block, strict=True):
                mask = np.zeros(len(sims), dtype=bool)
                mask[taken[i]] = True
                for spec in numbers:
                    if i in left[spec.method]:
                        found, *_ = whole_list(cat, stock, spec, profiles[i], sims, mask)
                        yield i, spec.method, len(np.unique(key[found]))

    def one_list(cat: Catalogue, stock: scan.Stock, spec: ListSpec, at: np.ndarray | None, sims: np.ndarray, taken: np.ndarray):
        """Places, similarities, labels and scores of a list from the items ``at`` some places, or from all."""
        places = slice(None) if at is None else at
        found = candidates(spec, sims, taken, cat.group[places])
        sims, found = sims[found], found if at is None else at[found]
        labels = None
        if spec.cov:
            labels = cat.cluster[found] if cat.cluster is not None else local_kmeans(
                stock.rows(found), n_clusters, seed
            )
        if not spec.greedy:
            n = len(found) if spec.k is None else spec.k
            found, sims = found[:n], sims[:n]
            scores = sims
        else:
            picks, scores = greedy_picks(spec, stock.rows(found), sims, labels)
            found, sims = found[picks], sims[picks]
            labels = labels[picks] if labels is not None else None
        if labels is None and cat.cluster is not None:
            labels = cat.cluster[found]
        return found, sims, labels, scores

    def whole_list(cat: Catalogue, stock: scan.Stock, spec: ListSpec, user: np.ndarray, sims: np.ndarray, taken: np.ndarray):
        if not spec.searches_all:
            return one_list(cat, stock, spec, None, sims, taken)
        found = candidates(spec, sims, taken, cat.group)
        found, scores = greedy_everywhere(spec, user, stock.rows(slice(None)), sims, found)
        return found, sims[found], cat.cluster[found] if cat.cluster is not None else None, scores

    def reach(spec: ListSpec, n_taken: int) -> int | None:
        """How many of the most similar items decide a list, or may; None where all do."""
        if spec.threshold is not None or spec.searches_all or (spec.cut is None and not (spec.dedupe and spec.k)):
            return None
        return (4 * spec.k + 64 if spec.cut is None else spec.cut) + (n_taken if spec.drops_first else 0)

    def group_lists(cat: Catalogue, stock: scan.Stock, profiles: np.ndarray, taken: list[np.ndarray]):
        """``(row, spec, places, similarities, labels, scores)`` of all lists of a group of users."""
        wide = stock.can(profiles)
        whole = [[] for _ in profiles]  # lists for which all items are scored
        for spec in shown:
            if not (spec.searches_all and wide):
                continue
            shut = taken if spec.drops_first else [np.zeros(0, np.int64)] * len(taken)
            for i, (found, scores) in enumerate(stock.greedy(spec, profiles, shut)):
                labels = cat.cluster[found] if cat.cluster is not None else None
                yield i, spec, found, stock.exact(profiles[i], found), labels, scores
        wanted = [[reach(spec, len(t)) for spec in shown] for t in taken]
        most = np.array([max([w for w in row if w is not None], default=0) for row in wanted])
        near = stock.nearest(profiles, most) if wide and most.any() else [None] * len(profiles)
        for i, seen in enumerate(near):
            for spec, w in zip(shown, wanted[i], strict=True):
                if spec.searches_all and wide:
                    continue
                if seen is None or w is None:
                    whole[i].append(spec)
                    continue
                at, sims = seen
                made = one_list(cat, stock, spec, at, sims, np.isin(at, taken[i]))
                if spec.cut is None and len(made[0]) < spec.k:  # too few groups among them
                    whole[i].append(spec)
                else:
                    yield i, spec, *made
        rest = [i for i, left in enumerate(whole) if left]
        step = max(1, SCORE_CHUNK // max(1, stock.n))
        for start in range(0, len(rest), step):
            block = stock.similarities(profiles[rest[start : start + step]])
            for i, sims in zip(rest[start : start + step], block, strict=True):
                mask = np.zeros(len(sims), dtype=bool)
                mask[taken[i]] = True
                for spec in whole[i]:
                    yield i, spec, *whole_list(cat, stock, spec, profiles[i], sims, mask)

    def flush(cat: Catalogue, texts: tuple[pa.Array, pa.Array], lists: list) -> pa.RecordBatch:
        sizes = [len(found) for _, _, found, *_ in lists]
        items_at = np.concatenate([found for _, _, found, *_ in lists])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([user for user, *_ in lists], sizes)),
                pa.array(np.repeat(np.array([m for _, m, *_ in lists], dtype=object), sizes)),
                pa.array(np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes])),
                pa.array(cat.item_id[items_at]),
                *[text.take(pa.array(items_at)) for text in texts],
                pa.array(np.concatenate([sims for *_, sims, _, _ in lists])),
                pa.concat_arrays(
                    [
                        pa.array(np.asarray(labels, dtype=np.int64))
                        if labels is not None
                        else pa.nulls(n, pa.int64())
                        for (*_, labels, _), n in zip(lists, sizes, strict=True)
                    ]
                ),
                pa.array(np.concatenate([scores for *_, scores in lists])),
                *([pa.nulls(len(items_at), pa.int64())] if counted else []),
            ],
            schema=schema,
        )

    def flush_counts(rows: list) -> pa.RecordBatch:
        known = dict(zip(("user_id", "method", "n_keys"), zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(rows), f.type) for f in schema], schema=schema
        )

    def serve(cat: Catalogue, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock = scan.Stock(cat.vectors, metric == "cosine")
        by_code = cat.positions_by_code()
        texts = pa.array(cat.code, pa.string()), pa.array(cat.section, pa.string())
        keys = key_numbers(*texts) if numbers else None
        waiting: list = []
        rows = 0
        for batch in batches:
            ids = batch.column("user_id").to_numpy()
            mine = [[by_code[c] for c in sorted(codes)] for codes in batch.column("codes").to_pylist()]
            for start in range(0, len(ids), scan.GROUP):
                part = mine[start : start + scan.GROUP]
                profiles = np.stack([cat.profile(t, cat.vectors, dedupe_profile) for t in part])
                taken = [np.unique(np.concatenate(t)) for t in part]
                counts = [(ids[start + i], *row) for i, *row in key_counts(cat, stock, keys, profiles, taken) if row[-1]] if numbers else None
                if counts:
                    yield flush_counts(counts)
                for i, spec, found, sims, labels, scores in group_lists(cat, stock, profiles, taken):
                    if len(found):
                        waiting.append((ids[start + i], spec.method, found, sims, labels, scores))
                        rows += len(found)
                    if rows >= FLUSH_ROWS:
                        yield flush(cat, texts, waiting)
                        waiting, rows = [], 0
        if waiting:
            yield flush(cat, texts, waiting)

    return serve


def row_schema(counted: Sequence[str]) -> str:
    return f"{RECOMMENDATION}, n_keys bigint" if counted else RECOMMENDATION


def key_numbers(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values, null a value like others, and how many rows have each number."""
    coded = [c.dictionary_encode(null_encoding="encode") for c in columns]
    whole = np.zeros(len(columns[0]), np.int64)
    for column in coded:
        whole = whole * (len(column.dictionary) + 1) + column.indices.to_numpy()
    _, number, held = np.unique(whole, return_inverse=True, return_counts=True)
    return number, held


def recommend_small(users: DataFrame, catalogue: Catalogue, specs: Sequence[ListSpec], *settings) -> DataFrame:
    """The lists of users ``(user_id, codes)`` from a catalogue that is sent to the tasks."""
    shipped = users.sparkSession.sparkContext.broadcast(catalogue)
    serve = server(specs, *settings)
    # A user is a few bytes and much work: state the number of tasks.
    return spread(users.select("user_id", "codes"), "user_id").mapInArrow(
        lambda batches: serve(shipped.value, batches), row_schema(settings[-1])
    )


def recommend(
    history: DataFrame,
    items: DataFrame,
    specs: Sequence[ListSpec] | ListSpec,
    metric: str = "cosine",
    dedupe_profile: bool = False,
    n_clusters: int = 10,
    seed: int = 42,
    limit: int = SHIPPED_BYTES,
    counted: Sequence[str] = (),
) -> DataFrame:
    """The lists of ``specs`` for every user of ``history``.

    ``items`` has ``item_id, code, section, embedding`` and may have ``cluster`` (used by
    the coverage term; without it each user's candidates are clustered) and ``group_id``
    (items that count as the same text).  A catalogue beyond ``limit`` bytes is not shipped by the
    driver; with a limit of 0 it goes by cells whatever its size. A list whose method is ``counted``
    comes as one row with the number of its different (code, section) in ``n_keys``, if it is not empty.
    """
    specs = [specs] if isinstance(specs, ListSpec) else list(specs)
    raw = unit_items(items, "ip")
    catalogue = small_catalogue(raw, limit)
    settings = (metric, dedupe_profile, n_clusters, seed, tuple(counted))
    if catalogue is not None:
        return recommend_small(matched_codes(history, items), catalogue, specs, *settings)
    if is_dealt(raw, limit):
        users = matched_codes(history, items)
        return deal(items, users, "user_id", server(specs, *settings), row_schema(counted))
    profiles = user_profiles(history, items, dedupe_profile)
    ready = unit_items(items, metric)
    made = blocks.recommend_blocked(history, profiles, ready, specs, n_clusters, seed)
    return count_keys(made, counted) if counted else made


def count_keys(recs: DataFrame, counted: Sequence[str]) -> DataFrame:
    """The lists of the ``counted`` methods as one row per user with ``n_keys``."""
    recs = cut_lineage(recs)
    numbers = recs.where(F.col("method").isin(*counted)).groupBy("user_id", "method").agg(
        F.countDistinct(F.struct("code", "section")).alias("n_keys")
    )
    return recs.where(~F.col("method").isin(*counted)).unionByName(numbers, allowMissingColumns=True)


def score_summary(profiles: DataFrame, items: DataFrame, limit: int = SHIPPED_BYTES) -> DataFrame:
    """Every user against every item, reduced to ``n, mean, low, high`` per user.

    No score row is ever emitted.  The mean needs no pairs at all; the extremes come
    from the catalogue in the tasks, or from the nearest and farthest item of the cell search.
    """
    ready = unit_items(items)
    catalogue = small_catalogue(ready, limit)
    schema = "user_id bigint, n bigint, mean_sim double, low_sim double, high_sim double"

    def reduce(vectors: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            users = batch.column("user_id").to_numpy()
            rows = [
                (users[r], len(s), s.mean(), s.min(), s.max())
                for r, s in score_chunks(batch, vectors)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(c), t)
                    for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)
                ],
                names=["user_id", "n", "mean_sim", "low_sim", "high_sim"],
            )

    users = profiles.select("user_id", "vec")
    if catalogue is not None:
        shipped = profiles.sparkSession.sparkContext.broadcast(catalogue.vectors)
        return spread(users, "user_id").mapInArrow(lambda batches: reduce(shipped.value, batches), schema)
    if is_dealt(ready, limit):
        return deal(items, users, "user_id", lambda cat, batches: reduce(unit_matrix(cat), batches), schema)
    return blocks.score_summary_blocked(profiles, ready)


def score_pairs(pairs: DataFrame, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """Cosine of each listed ``(user_id, item_id)`` pair: two equi-joins and one product."""
    ready = unit_items(items).select("item_id", F.col("embedding").alias("item_vec"))
    return (
        pairs.join(ready, "item_id")
        .join(profiles.select("user_id", "vec"), "user_id")
        .select("user_id", "item_id", dot(F.col("vec"), F.col("item_vec")).alias("sim"))
    )
