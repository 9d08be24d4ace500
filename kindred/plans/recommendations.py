"""Profiles, scores and recommendation lists over all users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.vectors import as_double, l2_normalise, vector_mean
from kindred.operators import compare, lists, profiles, search, selection
from kindred.operators.ingest import text_key
from kindred.plans.bind import (
    BASE,
    HISTORY,
    ITEMS,
    NAMES,
    UNIT_ITEMS,
    history,
    items,
    names,
    profiles_sql,
    table,
)
from kindred.plans.registry import query
from kindred.session import cut_lineage

LIST_COLUMNS = "user_id, pos, item_id, code, section, round(sim, 6) AS sim"


def shape(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "user_id", "pos", "item_id", "code", "section", F.round("sim", 6).alias("sim"), *extra
    )


def vector_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("dim", "x")).select(
        key, "dim", F.round("x", 6).alias("x")
    )


def vector_rows_sql(source: str, key: str, vec: str) -> str:
    return f"""SELECT {key}, CAST(dim - 1 AS INT) AS dim, round(x, 6) AS x
      FROM (SELECT {key}, generate_subscripts({vec}, 1) AS dim, unnest({vec}) AS x FROM {source})"""


def greedy_sql(
    candidates: str, k: int, rel: float, div: float = 0.0, cov: float = 0.0,
    penalty: str = "mean", by_similarity: bool = True, cluster: str = "",
) -> str:
    """Greedy selection as a recursive CTE with one row per open candidate.

    A row carries the running maximum or sum of similarities to the list and the number of picks
    from its cluster; the row ranked first is the pick of its round.
    """
    tie = "sim DESC, item_id" if by_similarity else "item_id"
    first = f"{rel} * sim + {cov}" if by_similarity else "sim"
    near = "list_inner_product(u.embedding, b.embedding)" if div else "0.0"
    start, grown = ("-2.0", f"greatest(s.acc, {near})") if penalty == "max" else ("0.0", f"s.acc + {near}")
    score = f"{rel} * sim"
    if div:
        score += f" - {div} * acc" + ("" if penalty == "max" else " / pos")
    if cov:
        score += f" + {cov} * (1 - same * 1.0 / steps)"
    best = "OVER (PARTITION BY user_id)"
    return f"""
cand AS ({candidates}),
sized AS (SELECT user_id, least({k}, count(*)) AS steps FROM cand GROUP BY user_id),
state AS (
  SELECT user_id, {"steps" if cluster == "length" else f"{k}"} AS steps, 1 AS pos, item_id, sim, cluster,
         {start}::DOUBLE AS acc, 0 AS same, row_number() OVER (PARTITION BY user_id ORDER BY {first} DESC, {tie}) AS rn
  FROM cand JOIN sized USING (user_id)
  UNION ALL
  SELECT user_id, steps, pos + 1, item_id, sim, cluster, acc, same,
         row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {tie}) AS rn
  FROM (SELECT *, {score} AS score
        FROM (SELECT s.user_id, s.steps, s.pos, s.item_id, s.sim, s.cluster, {grown} AS acc,
                     s.same + CASE WHEN s.cluster = s.best_cluster THEN 1 ELSE 0 END AS same
              FROM (SELECT *, arg_min(item_id, rn) {best} AS best_id, arg_min(cluster, rn) {best} AS best_cluster
                    FROM state) s
              JOIN unit_items u ON u.item_id = s.item_id JOIN unit_items b ON b.item_id = s.best_id
              WHERE s.rn > 1 AND s.pos < {k}))),
picks AS (SELECT p.user_id, p.pos, p.item_id, u.code, u.section, p.sim, p.cluster
          FROM state p JOIN unit_items u USING (item_id) WHERE p.rn = 1)"""


PICKED = f"SELECT {LIST_COLUMNS} FROM picks"
PICKED_CLUSTER = f"SELECT {LIST_COLUMNS}, cluster FROM picks"
UNTAKEN = """SELECT s.user_id, s.item_id, s.code, s.section, s.sim, s.cluster, u.embedding
  FROM scores s JOIN unit_items u USING (item_id) ANTI JOIN taken t ON t.user_id = s.user_id AND t.code = s.code"""


def top_pool(n: int, drop_taken: bool) -> str:
    anti = "ANTI JOIN taken t ON t.user_id = s.user_id AND t.code = s.code" if drop_taken else ""
    return f"""SELECT s.user_id, s.item_id, s.code, s.section, s.sim, s.cluster, u.embedding
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM scores) s
  JOIN unit_items u USING (item_id) {anti} WHERE s.rn <= {n}"""


# ---- building blocks ----------------------------------------------------------------


@query(
    "vector_mean",
    f"""WITH {ITEMS}, m AS (
  SELECT code, i, avg(v) AS x FROM
    (SELECT code, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM items)
  GROUP BY code, i)
SELECT code, CAST(i - 1 AS INT) AS dim, round(x, 6) AS x FROM m""",
)
def _vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = items(spark, sf).groupBy("code").agg(
        vector_mean(as_double(F.col("embedding"))).alias("mean")
    )
    return vector_rows(means, "code", "mean")


@query(
    "l2_normalise",
    f"""WITH {ITEMS}, d AS (
  SELECT item_id, list_transform(embedding, lambda x: x * (item_id % 7)) AS v FROM items),
u AS (SELECT item_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u
      FROM (SELECT item_id, v, sqrt(list_inner_product(v, v)) AS n FROM d))
{vector_rows_sql("u", "item_id", "u")}""",
)
def _l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    scaled = items(spark, sf).select(
        "item_id",
        F.transform(as_double(F.col("embedding")), lambda x: x * (F.col("item_id") % 7)).alias("v"),
    )
    return vector_rows(scaled.select("item_id", l2_normalise(F.col("v")).alias("u")), "item_id", "u")


@query(
    "user_profile",
    f"WITH {ITEMS},{HISTORY},{profiles_sql()} {vector_rows_sql('profiles', 'user_id', 'vec')}",
)
def _user_profile(spark: SparkSession, sf: str) -> DataFrame:
    made = profiles.user_profiles(history(spark, sf), items(spark, sf))
    return vector_rows(made, "user_id", "vec")


FIRST_OF_CODE = """SELECT h.user_id, i.embedding FROM history h JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY item_id) AS rn FROM items)
     WHERE rn = 1) i USING (code)"""


@query(
    "user_profile_dedup",
    f"WITH {ITEMS},{HISTORY},{profiles_sql(FIRST_OF_CODE)} {vector_rows_sql('profiles', 'user_id', 'vec')}",
)
def _user_profile_dedup(spark: SparkSession, sf: str) -> DataFrame:
    made = profiles.user_profiles(history(spark, sf), items(spark, sf), dedupe_by_code=True)
    return vector_rows(made, "user_id", "vec")


SEEN = """
seen AS (
  SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id
  FROM events WHERE event_type <> 'purchase')"""


@query(
    "score_cosine",
    f"""WITH {ITEMS},{HISTORY},{profiles_sql()},{UNIT_ITEMS},{SEEN}
SELECT s.user_id, s.item_id, round(list_inner_product(p.vec, i.embedding), 6) AS sim
FROM seen s JOIN profiles p USING (user_id) JOIN unit_items i USING (item_id)""",
)
def _score_cosine(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    seen = (
        table(spark, sf, "events")
        .where(F.col("event_type") != "purchase")
        .select("user_id", k.alias("item_id"))
        .distinct()
    )
    mine = profiles.user_profiles(history(spark, sf), items(spark, sf))
    scored = search.score_pairs(seen, mine, items(spark, sf))
    return scored.select("user_id", "item_id", F.round("sim", 6).alias("sim"))


@query(
    "cross_user_item_scores",
    f"""WITH {BASE}
SELECT user_id, count(*) AS n, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS low_sim,
       round(max(sim), 6) AS high_sim FROM scores GROUP BY user_id""",
)
def _cross_user_item_scores(spark: SparkSession, sf: str) -> DataFrame:
    mine = profiles.user_profiles(history(spark, sf), items(spark, sf))
    summary = search.score_summary(mine, items(spark, sf))
    return summary.select(
        "user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_sim", "low_sim", "high_sim")]
    )


@query(
    "topn_search",
    f"""WITH {BASE}
SELECT user_id, item_id, CAST(rn AS INT) AS pos, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM scores)
WHERE rn <= 1000""",
)
def _topn_search(spark: SparkSession, sf: str) -> DataFrame:
    spec = selection.ListSpec("search", k=1000, taken="keep")
    found = search.recommend(history(spark, sf), items(spark, sf), spec)
    return found.select("user_id", "item_id", "pos", F.round("sim", 6).alias("sim"))


@query(
    "semi_taken_items",
    f"WITH {ITEMS},{HISTORY} SELECT h.user_id, i.item_id, i.code, i.section FROM history h JOIN items i USING (code)",
)
def _semi_taken_items(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.taken_items(history(spark, sf), items(spark, sf))


@query(
    "filter_in_list",
    f"WITH {ITEMS},{HISTORY} SELECT item_id, code, section FROM items i SEMI JOIN history h USING (code)",
)
def _filter_in_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = history(spark, sf).select("code").distinct()
    return items(spark, sf).select("item_id", "code", "section").join(wanted, "code", "left_semi")


@query(
    "anti_taken_items",
    f"""WITH {BASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM scores)
SELECT user_id, item_id, code, section FROM ranked r
ANTI JOIN taken t ON t.user_id = r.user_id AND t.code = r.code WHERE rn <= 1000""",
)
def _anti_taken_items(spark: SparkSession, sf: str) -> DataFrame:
    spec = selection.ListSpec("search", k=1000, taken="keep")
    found = search.recommend(history(spark, sf), items(spark, sf), spec)
    return lists.drop_taken(found, history(spark, sf)).select("user_id", "item_id", "code", "section")


# ---- lists --------------------------------------------------------------------------


@query(
    "recommend_topk",
    f"""WITH {BASE}
SELECT {LIST_COLUMNS.replace("pos", "CAST(rn AS INT) AS pos")} FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY sim DESC, item_id) AS rn
  FROM scores s ANTI JOIN taken t ON t.user_id = s.user_id AND t.code = s.code)
WHERE rn <= 30""",
)
def _recommend_topk(spark: SparkSession, sf: str) -> DataFrame:
    return shape(search.recommend(history(spark, sf), items(spark, sf), selection.topk(30)))


@query(
    "recommend_threshold",
    f"""WITH {BASE}
SELECT {LIST_COLUMNS.replace("pos", "CAST(rn AS INT) AS pos")} FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY sim DESC, item_id) AS rn
  FROM scores s ANTI JOIN taken t ON t.user_id = s.user_id AND t.code = s.code
  WHERE sim <= 0.5)""",
)
def _recommend_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return shape(search.recommend(history(spark, sf), items(spark, sf), selection.threshold(0.5)))


@query(
    "recommend_mmr",
    f"WITH RECURSIVE {BASE}, {greedy_sql(UNTAKEN, 30, 0.5, 0.5, penalty='max', by_similarity=False)} {PICKED}",
)
def _recommend_mmr(spark: SparkSession, sf: str) -> DataFrame:
    return shape(search.recommend(history(spark, sf), items(spark, sf), selection.mmr(30, 0.5)))


@query(
    "recommend_maxsum",
    f"WITH RECURSIVE {BASE}, {greedy_sql(UNTAKEN, 30, 0.5, 0.5, penalty='mean', by_similarity=False)} {PICKED}",
)
def _recommend_maxsum(spark: SparkSession, sf: str) -> DataFrame:
    return shape(search.recommend(history(spark, sf), items(spark, sf), selection.maxsum(30, 0.5)))


@query(
    "recommend_xquad",
    f"WITH RECURSIVE {BASE}, {greedy_sql(top_pool(300, True), 30, 0.6, cov=0.4)} {PICKED_CLUSTER}",
)
def _recommend_xquad(spark: SparkSession, sf: str) -> DataFrame:
    found = search.recommend(history(spark, sf), items(spark, sf), selection.xquad(30, 300, 0.6))
    return shape(found, "cluster")


@query(
    "recommend_final",
    f"""WITH RECURSIVE {BASE},
{greedy_sql(top_pool(1000, False), 500, 0.6, 0.25, 0.15, cluster="length")} {PICKED_CLUSTER}""",
)
def _recommend_final(spark: SparkSession, sf: str) -> DataFrame:
    return shape(
        search.recommend(history(spark, sf), items(spark, sf), selection.final(500, 1000)), "cluster"
    )


@query(
    "recommend_final_untaken",
    f"""WITH RECURSIVE {BASE},
{greedy_sql(top_pool(1000, True), 500, 0.4, 0.25, 0.15, cluster="length")} {PICKED_CLUSTER}""",
)
def _recommend_final_untaken(spark: SparkSession, sf: str) -> DataFrame:
    found = search.recommend(history(spark, sf), items(spark, sf), selection.final_untaken(500, 1000))
    return shape(found, "cluster")


@query("recommend_final_clustered")
def _recommend_final_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The final list at full size: 1,000 candidates, clusters fitted per user, 500 picks."""
    plain = items(spark, sf).drop("cluster")
    found = search.recommend(history(spark, sf), plain, selection.final(500, 1000))
    return shape(found, "cluster")


@query(
    "recommend_baseline",
    f"""WITH {ITEMS},{HISTORY},{NAMES},{profiles_sql(FIRST_OF_CODE)},{UNIT_ITEMS},
scores AS (SELECT p.user_id, i.item_id, i.code, i.section, coalesce(n.text, '') AS text,
                  list_inner_product(p.vec, i.embedding) AS sim
           FROM profiles p, unit_items i LEFT JOIN names n USING (item_id)),
untaken AS (SELECT s.* FROM scores s ANTI JOIN history h ON h.user_id = s.user_id AND h.code = s.code),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY sim DESC, item_id) AS rt
         FROM untaken) WHERE rt = 1)
SELECT {LIST_COLUMNS.replace("pos", "CAST(rn AS INT) AS pos")}
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM once)
WHERE rn <= 10""",
)
def _recommend_baseline(spark: SparkSession, sf: str) -> DataFrame:
    grouped = lists.with_text_groups(items(spark, sf), names(spark, sf))
    found = search.recommend(
        history(spark, sf), grouped, selection.baseline(10), dedupe_profile=True
    )
    return shape(found)


@query(
    "recommend_cut_then_filter",
    f"""WITH {BASE}, cut AS ({top_pool(100, True)})
SELECT {LIST_COLUMNS.replace("pos", "CAST(rn AS INT) AS pos")}
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM cut)
WHERE rn <= 10""",
)
def _recommend_cut_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = search.recommend(history(spark, sf), items(spark, sf), selection.cut_then_filter(10, 100))
    return shape(found)


GE_LIST = f"""WITH {BASE}, {NAMES},
cut AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS pos
        FROM ({top_pool(100, True)})),
once AS (SELECT user_id, code, min(pos) AS first_pos, max_by(section, pos) AS section
         FROM cut WHERE starts_with(code, 'GE') GROUP BY user_id, code),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_pos) AS pos FROM once),
first_names AS (SELECT code, min_by(name, item_id) AS name FROM items JOIN names USING (item_id) GROUP BY code)
SELECT user_id, CAST(pos AS INT) AS pos, code, section, coalesce(name, '(no name)') AS name
FROM ranked LEFT JOIN first_names USING (code) WHERE pos <= 10"""


@query("list_prefix_deduped", GE_LIST)
def _list_prefix_deduped(spark: SparkSession, sf: str) -> DataFrame:
    found = search.recommend(
        history(spark, sf), items(spark, sf), selection.cut_then_filter(None, 100)
    )
    short = lists.prefix_deduped(found, "GE", 10)
    named = lists.first_names(items(spark, sf), names(spark, sf))
    return lists.look_up_names(short, named, "(no name)").select(
        "user_id", "pos", "code", "section", "name"
    )


@query(
    "dedupe_first_pos_last_value",
    f"""WITH {BASE},
cut AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS pos
        FROM ({top_pool(1000, False)}))
SELECT user_id, code, CAST(min(pos) AS INT) AS first_pos, max_by(section, pos) AS section
FROM cut GROUP BY user_id, code""",
)
def _dedupe_first_pos_last_value(spark: SparkSession, sf: str) -> DataFrame:
    spec = selection.ListSpec("search", k=1000, taken="keep")
    return lists.first_pos_last_value(search.recommend(history(spark, sf), items(spark, sf), spec))


@query(
    "join_names_left",
    f"""WITH {BASE}, {NAMES},
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM scores)
SELECT t.user_id, CAST(t.rn AS INT) AS pos, t.code, t.section, n.name
FROM top t LEFT JOIN (SELECT i.code, i.section, names.name FROM items i JOIN names USING (item_id)) n
  ON n.code = t.code AND n.section = t.section
WHERE t.rn <= 30""",
)
def _join_names_left(spark: SparkSession, sf: str) -> DataFrame:
    found = search.recommend(
        history(spark, sf), items(spark, sf), selection.ListSpec("search", k=30, taken="keep")
    )
    named = items(spark, sf).join(names(spark, sf), "item_id").select("code", "section", "name")
    return found.join(named, ["code", "section"], "left").select(
        "user_id", "pos", "code", "section", "name"
    )


@query(
    "lookup_first_name",
    f"""WITH {ITEMS},{HISTORY},{NAMES},
first_names AS (SELECT code, min_by(name, item_id) AS name FROM items JOIN names USING (item_id) GROUP BY code)
SELECT h.user_id, h.code, coalesce(f.name, '(no name)') AS name
FROM history h LEFT JOIN first_names f USING (code)""",
)
def _lookup_first_name(spark: SparkSession, sf: str) -> DataFrame:
    named = lists.first_names(items(spark, sf), names(spark, sf))
    return lists.look_up_names(history(spark, sf), named, "(no name)").select("user_id", "code", "name")


# ---- experiment and comparison ------------------------------------------------------

EXPERIMENT = [
    selection.topk(30),
    selection.threshold(0.5),
    selection.mmr(30, 0.5),
    selection.maxsum(30, 0.5),
    selection.xquad(30, 300, 0.6),
]


def greedy_block(name: str, *args, **kwargs) -> str:
    text = greedy_sql(*args, **kwargs)
    for cte in ("cand", "sized", "state", "picks"):
        text = text.replace(f"{cte} ", f"{name}_{cte} ").replace(f"{cte})", f"{name}_{cte})")
    return text


EXPERIMENT_SQL = f"""WITH RECURSIVE {BASE},
untaken AS ({UNTAKEN}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn FROM untaken),
under AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rn
          FROM untaken WHERE sim <= 0.5),
{greedy_block("mmr", "SELECT * FROM untaken", 30, 0.5, 0.5, penalty="max", by_similarity=False)},
{greedy_block("maxsum", "SELECT * FROM untaken", 30, 0.5, 0.5, by_similarity=False)},
{greedy_block("xquad", top_pool(300, True), 30, 0.6, cov=0.4)},
results AS (
  SELECT 'topk' AS method, user_id, CAST(rn AS INT) AS pos, item_id, code, section, sim FROM ranked WHERE rn <= 30
  UNION ALL SELECT 'threshold', user_id, CAST(rn AS INT), item_id, code, section, sim FROM under
  UNION ALL SELECT 'mmr', user_id, pos, item_id, code, section, sim FROM mmr_picks
  UNION ALL SELECT 'maxsum', user_id, pos, item_id, code, section, sim FROM maxsum_picks
  UNION ALL SELECT 'xquad', user_id, pos, item_id, code, section, sim FROM xquad_picks)"""


def experiment(
    spark: SparkSession, sf: str, methods: Sequence[str] = compare.METHODS, counted: Sequence[str] = ()
) -> DataFrame:
    """The lists of ``methods``; a threshold list is nearly the catalogue, so only who reads it asks for it.

    Those ``counted`` come as the number of their items.
    """
    specs = [s for s in EXPERIMENT if s.method in methods]
    return search.recommend(history(spark, sf), items(spark, sf), specs, counted=counted)


@query("run_experiment", f"{EXPERIMENT_SQL} SELECT method, {LIST_COLUMNS} FROM results")
def _run_experiment(spark: SparkSession, sf: str) -> DataFrame:
    return shape(experiment(spark, sf), "method")


TAGGED = """, tagged AS (
  SELECT user_id, code, section, bool_or(method = 'topk') AS t, bool_or(method = 'threshold') AS h,
         bool_or(method = 'mmr') AS m, bool_or(method = 'maxsum') AS s, bool_or(method = 'xquad') AS x
  FROM results GROUP BY user_id, code, section)"""


@query(
    "compare_result_sets",
    f"""{EXPERIMENT_SQL}{TAGGED}
SELECT user_id, count(*) FILTER (t) AS n_topk, count(*) FILTER (h) AS n_threshold,
       count(*) FILTER (m) AS n_mmr, count(*) FILTER (s) AS n_maxsum, count(*) FILTER (x) AS n_xquad,
       count(*) FILTER (t AND m AND s AND x) AS n_common,
       count(*) FILTER (t AND NOT (m OR s OR x)) AS n_only_topk,
       count(*) FILTER (x AND NOT t) AS n_xquad_not_topk
FROM tagged GROUP BY user_id""",
)
def _compare_result_sets(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_sets(experiment(spark, sf, counted=["threshold"]))


@query("set_intersect", f"{EXPERIMENT_SQL}{TAGGED} SELECT user_id, code, section FROM tagged WHERE t AND m AND s AND x")
def _set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    methods = ["topk", "mmr", "maxsum", "xquad"]
    return compare.common_items(experiment(spark, sf, methods), methods)


@query(
    "set_except",
    f"""{EXPERIMENT_SQL}{TAGGED}
SELECT 'only_topk' AS side, user_id, code, section FROM tagged WHERE t AND NOT (m OR s OR x)
UNION ALL SELECT 'xquad_not_topk', user_id, code, section FROM tagged WHERE x AND NOT t""",
)
def _set_except(spark: SparkSession, sf: str) -> DataFrame:
    made = cut_lineage(experiment(spark, sf, ["topk", "mmr", "maxsum", "xquad"]))
    only = compare.items_only_in(made, "topk", ["mmr", "maxsum", "xquad"])
    extra = compare.items_only_in(made, "xquad", ["topk"])
    return only.select(F.lit("only_topk").alias("side"), "*").unionByName(
        extra.select(F.lit("xquad_not_topk").alias("side"), "*")
    )


# ---- ranking and deduplication on plain tables --------------------------------------


@query(
    "sort_limit",
    "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(10)
        .select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    )


@query("offset_nth", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 1 OFFSET 222")
def _offset_nth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name").offset(222).limit(1)


@query(
    "dedupe_keep_first",
    "SELECT text, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text",
)
def _dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """First row of each text; an aggregate, so copies collapse before the shuffle."""
    docs = table(spark, sf, "documents").select("text", "doc_id", "source")
    keyed = docs.withColumn("text_key", text_key())
    return lists.keep_first(keyed, ["text_key"], "doc_id").drop("text_key")


@query(
    "cluster_sizes",
    f"WITH {ITEMS} SELECT cluster, count(*) AS n FROM items GROUP BY cluster",
)
def _cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))


@query(
    "cluster_head_n",
    f"""WITH {ITEMS}
SELECT cluster, CAST(rn AS INT) AS pos, item_id FROM (
  SELECT cluster, item_id, row_number() OVER (PARTITION BY cluster ORDER BY item_id) AS rn FROM items)
WHERE rn <= 10""",
)
def _cluster_head_n(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy("item_id")
    return (
        items(spark, sf)
        .select("cluster", "item_id", F.row_number().over(order).alias("pos"))
        .where(F.col("pos") <= 10)
    )


@query(
    "cluster_sample_n",
    f"""WITH {ITEMS} SELECT cluster, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(item_id || ':42'), item_id) AS rn FROM items) WHERE rn <= 30""",
)
def _cluster_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return lists.sample_per_group(items(spark, sf).select("cluster", "item_id"), "cluster", "item_id", 30)


@query(
    "sample_cap",
    f"WITH {ITEMS} SELECT item_id, code, section FROM items ORDER BY md5(item_id || ':42'), item_id LIMIT 300",
)
def _sample_cap(spark: SparkSession, sf: str) -> DataFrame:
    return lists.sample_cap(items(spark, sf).select("item_id", "code", "section"), "item_id", 300)
