"""Text cleaning, TF-IDF, similar pairs and two-stage retrieval over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import encoders
from kindred.functions import text as tx
from kindred.operators import ingest, pairs, profiles, tfidf, two_stage
from kindred.plans.bind import (
    BASE,
    HISTORY,
    ITEMS,
    UNIT_ITEMS,
    history,
    items,
    table,
)
from kindred.plans.registry import query
from kindred.session import cut_lineage

STOP = "[" + ", ".join(f"'{w}'" for w in tx.EDU_STOPWORDS) + "]"


def tokens_sql(column: str = "text") -> str:
    return rf"""list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^가-힣a-z0-9\s]', ' ', 'g'), '\s+'),
      lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"""


def clean_sql(column: str = "text") -> str:
    return f"array_to_string({tokens_sql(column)}, ' ')"


def counts_sql(source: str = "documents", pairs: bool = True, name: str = "counts") -> str:
    grams = (
        "list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))"
        if pairs
        else "toks"
    )
    return f"""
{name} AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({grams}) AS term
        FROM (SELECT doc_id, {tokens_sql()} AS toks FROM {source}))
  GROUP BY doc_id, term)"""


def tfidf_sql(source: str = "documents", pairs: bool = True, cap: int | None = None) -> str:
    limit = f"ORDER BY total DESC, term LIMIT {cap}" if cap else ""
    return f"""{counts_sql(source, pairs)},
size AS (SELECT count(*) AS n FROM {source}),
freq AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.85 * (SELECT n FROM size) {limit}),
raw AS (
  SELECT c.doc_id, c.term, (1 + ln(c.tf)) * (ln((1.0 + s.n) / (1.0 + f.df)) + 1) AS w
  FROM counts c JOIN freq f USING (term), size s),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM raw GROUP BY doc_id),
tfidf AS (SELECT raw.doc_id, term, w / len AS weight FROM raw JOIN lengths USING (doc_id))"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


# ---- cleaning -----------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {clean_sql()} AS cleaned FROM documents")
def _clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(
    "weighted_text",
    f"""WITH f AS (SELECT doc_id, {clean_sql("split_part(text, chr(10), 1)")} AS name,
  {clean_sql()} AS goal, {clean_sql("source")} AS overview FROM documents)
SELECT doc_id, trim(concat_ws(' ', CASE WHEN name <> '' THEN repeat(' ' || name, 3) END,
  CASE WHEN goal <> '' THEN ' ' || goal END,
  CASE WHEN overview <> '' THEN ' ' || overview END)) AS weighted FROM f""",
)
def _weighted_text(spark: SparkSession, sf: str) -> DataFrame:
    fields = {
        "교과목명": F.substring_index("text", "\n", 1),
        "강의목표": F.col("text"),
        "강의개요": F.col("source"),
    }
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.weighted_text(fields).alias("weighted"))


@query("concat_fields", "SELECT doc_id, concat_ws(' ', lang, source, text) AS joined FROM documents")
def _concat_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", tx.concat_fields("lang", "source", "text").alias("joined")
    )


@query(
    "filter_nonempty_text",
    f"""WITH c AS (SELECT conv_id, turn, {clean_sql()} AS cleaned FROM conversations)
SELECT conv_id, turn, cleaned FROM c WHERE length(cleaned) > 0""",
)
def _filter_nonempty_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.clean_text(F.col("text")).alias("cleaned")
    )
    return turns.where(F.length("cleaned") > 0)


@query(
    "token_budget_audit",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS toks FROM documents)
SELECT doc_id, len(toks) AS n_tokens, len(toks) > 128 AS over, greatest(len(toks) - 128, 0) AS n_cut,
       array_to_string(toks[1:128], ' ') AS kept FROM t""",
)
def _token_budget_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.token_budget(documents(spark, sf), "doc_id", F.col("text"), 128)


@query(
    "label_preview",
    r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')[1:2], ' ') AS label
FROM documents""",
)
def _label_preview(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.label_preview(F.col("text")).alias("label"))


# ---- vectors of terms ---------------------------------------------------------------


@query(
    "document_frequency",
    f"WITH {tfidf_sql()} SELECT term, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 6) AS idf FROM freq, size",
)
def _document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    n = docs.count()
    kept = tfidf.prune(tfidf.document_frequency(tfidf.term_counts(docs)), n)
    return kept.select("term", "df", F.round(tfidf.idf(F.col("df"), n), 6).alias("idf"))


@query(
    "corpus_top_terms",
    f"WITH {tfidf_sql(pairs=False, cap=2000)} SELECT term, total FROM freq",
)
def _corpus_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    kept = tfidf.prune(tfidf.document_frequency(tfidf.term_counts(docs, pairs=False)), docs.count())
    return tfidf.top_terms(kept, 2000).select("term", "total")


@query("tfidf_vectors", f"WITH {tfidf_sql()} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    made = tfidf.tfidf(documents(spark, sf))
    return made.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_capped",
    f"WITH {tfidf_sql(pairs=False, cap=1000)} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf",
)
def _tfidf_capped(spark: SparkSession, sf: str) -> DataFrame:
    made = tfidf.tfidf(documents(spark, sf), pairs=False, max_features=1000)
    return made.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "count_vectors",
    f"WITH {tfidf_sql()} SELECT c.doc_id, c.term, c.tf FROM counts c SEMI JOIN freq f USING (term)",
)
def _count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    counts = cut_lineage(tfidf.term_counts(docs))
    kept = tfidf.prune(tfidf.document_frequency(counts), docs.count())
    return tfidf.with_frequency(counts, kept).select("doc_id", "term", "tf")


# ---- similar pairs ------------------------------------------------------------------

REPS_SQL = f"""
reps AS (SELECT min(doc_id) AS doc_id, count(*) AS n_copies
         FROM (SELECT doc_id, {clean_sql()} AS cleaned FROM documents) WHERE cleaned <> '' GROUP BY cleaned)"""


@query(
    "tfidf_cosine_pairs",
    f"""WITH {tfidf_sql()},{REPS_SQL},
mine AS (SELECT t.* FROM tfidf t SEMI JOIN reps r USING (doc_id)),
sims AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS sim
         FROM mine a JOIN mine b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_a, doc_b, ra.n_copies AS n_a, rb.n_copies AS n_b, round(sim, 6) AS sim
FROM sims JOIN reps ra ON ra.doc_id = doc_a JOIN reps rb ON rb.doc_id = doc_b WHERE sim >= 0.3""",
)
def _tfidf_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct texts; copies are collapsed first and come back as counts."""
    docs = documents(spark, sf)
    reps = tfidf.one_per_text(docs)
    weights = tfidf.tfidf(docs, numbers=True).join(reps.select("doc_id"), "doc_id", "left_semi")
    found = tfidf.similar_pairs(weights, 0.3)
    return (
        found.join(reps.toDF("doc_a", "n_a"), "doc_a")
        .join(reps.toDF("doc_b", "n_b"), "doc_b")
        .select("doc_a", "doc_b", "n_a", "n_b", F.round("sim", 6).alias("sim"))
    )


UNION_SQL = """
both_texts AS (SELECT doc_id * 2 AS doc_id, text FROM documents
         UNION ALL SELECT item_id * 2 + 1, text FROM benchmark)"""
ASKED_SQL = f"""{UNION_SQL},{tfidf_sql("both_texts")},
sims AS (SELECT (q.doc_id - 1) // 2 AS query_id, d.doc_id // 2 AS doc_id, sum(q.weight * d.weight) AS sim
         FROM tfidf q JOIN tfidf d ON q.term = d.term WHERE q.doc_id % 2 = 1 AND d.doc_id % 2 = 0 GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rn FROM sims)"""


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(
    "tfidf_topn",
    f"""WITH {ASKED_SQL}
SELECT query_id, doc_id, CAST(rn AS INT) AS pos, round(sim, 6) AS sim FROM top WHERE rn <= 100""",
)
def _tfidf_topn(spark: SparkSession, sf: str) -> DataFrame:
    found = two_stage.tfidf_topn(documents(spark, sf), benchmark_queries(spark, sf), 100)
    return found.select("query_id", "doc_id", "pos", F.round("sim", 6).alias("sim"))


@query(
    "union_distinct_ids",
    f"""WITH {ASKED_SQL}
SELECT DISTINCT query_id, id FROM (SELECT query_id, doc_id AS id FROM top WHERE rn <= 100
  UNION ALL SELECT item_id, item_id FROM benchmark)""",
)
def _union_distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    asked = benchmark_queries(spark, sf)
    found = two_stage.tfidf_topn(documents(spark, sf), asked, 100)
    mine = asked.select("query_id", F.col("query_id").alias("id"))
    return found.select("query_id", F.col("doc_id").alias("id")).unionByName(mine).distinct()


@query(
    "cosine_pairs_dense",
    f"""WITH {ITEMS},{UNIT_ITEMS}
SELECT a.item_id AS id_a, b.item_id AS id_b, round(list_inner_product(a.embedding, b.embedding), 6) AS sim
FROM unit_items a JOIN unit_items b ON a.item_id < b.item_id
WHERE list_inner_product(a.embedding, b.embedding) >= 0.25""",
)
def _cosine_pairs_dense(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.dense_pairs(items(spark, sf), 0.25)
    return found.select("id_a", "id_b", F.round("sim", 6).alias("sim"))


@query(
    "histogram_bins",
    f"""WITH {ITEMS},{UNIT_ITEMS},
sims AS (SELECT round(list_inner_product(a.embedding, b.embedding), 12) AS sim FROM unit_items a, unit_items b)
SELECT CAST(least(floor((sim + 1) / 2 * 50), 49) AS INT) AS bin, count(*) AS n FROM sims GROUP BY 1""",
)
def _histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_histogram(items(spark, sf), 50)


@query(
    "histogram_numeric",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n
      FROM lineitem, e GROUP BY 1)
SELECT bin, round(lo + bin * ((hi - lo) / 50), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 50), 4) AS high, n
FROM b, e""",
)
def _histogram_numeric(spark: SparkSession, sf: str) -> DataFrame:
    made = pairs.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)
    return made.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


HYBRID_SQL = f"""{tfidf_sql()},{ITEMS},{UNIT_ITEMS},
docs AS (SELECT d.doc_id, d.lang FROM documents d SEMI JOIN items i ON i.item_id = d.doc_id),
text_sims AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.weight * b.weight) AS tfidf
  FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id
  SEMI JOIN docs da ON da.doc_id = a.doc_id SEMI JOIN docs db ON db.doc_id = b.doc_id GROUP BY 1, 2),
blend AS (
  SELECT id_a, id_b, da.lang AS lang_a, db.lang AS lang_b, coalesce(t.tfidf, 0) AS tfidf, dense,
         0.65 * dense + 0.35 * coalesce(t.tfidf, 0) AS hybrid
  FROM (SELECT a.item_id AS id_a, b.item_id AS id_b, list_inner_product(a.embedding, b.embedding) AS dense
        FROM unit_items a JOIN unit_items b ON a.item_id < b.item_id) d
  JOIN docs da ON da.doc_id = id_a JOIN docs db ON db.doc_id = id_b LEFT JOIN text_sims t USING (id_a, id_b))"""


def languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("kind"))


def hybrid(spark: SparkSession, sf: str, at_least: float, kinds: DataFrame | None = None) -> DataFrame:
    """Documents with a vector; the text side is fitted on the whole corpus."""
    docs = documents(spark, sf)
    stock = items(spark, sf).join(docs.select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    ids = stock.select(F.col("item_id").alias("doc_id"))
    weights = tfidf.tfidf(docs, numbers=True).join(ids, "doc_id", "left_semi")
    return pairs.hybrid_pairs(weights, stock, at_least, kinds=kinds)


@query(
    "hybrid_similarity",
    f"WITH {HYBRID_SQL} SELECT id_a, id_b, round(hybrid, 6) AS hybrid FROM blend WHERE hybrid >= 0.2",
)
def _hybrid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf, 0.2).select("id_a", "id_b", F.round("hybrid", 6).alias("hybrid"))


@query(
    "pair_self_join",
    f"""WITH {HYBRID_SQL}
SELECT lang_a AS lang, id_a, id_b, round(tfidf, 6) AS tfidf, round(dense, 6) AS dense, round(hybrid, 6) AS hybrid
FROM blend WHERE hybrid >= 0.15 AND lang_a = lang_b""",
)
def _pair_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return same_language(hybrid(spark, sf, 0.15, languages(spark, sf)))


def same_language(found: DataFrame) -> DataFrame:
    """Pairs that met by language; documents of different ones do not meet at all."""
    return found.select(F.col("kind").alias("lang"), "id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("tfidf", "dense", "hybrid")])


# ---- two stages ---------------------------------------------------------------------


def vectors_sql(name: str, key: str, source: str) -> str:
    """The default encoder's vectors, one row per component that is not zero."""
    return f"""
{name}_sums AS (SELECT {key}, m % 64 AS dim, sum(CASE WHEN m // 64 % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x
  FROM (SELECT {key}, CAST('0x' || left(md5(t), 8) AS BIGINT) AS m
        FROM (SELECT {key}, unnest({tokens_sql()}) AS t FROM {source})) GROUP BY 1, 2),
{name}_size AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_sums GROUP BY 1),
{name} AS (SELECT s.{key}, dim, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS x
           FROM {name}_sums s JOIN {name}_size USING ({key}) WHERE x <> 0)"""


def text_vectors(texts: DataFrame, key: str) -> DataFrame:
    """``(key, vec)``: every text encoded; an empty one is the zero vector."""
    made = encoders.hashed_vectors(texts, key, tx.tokens(F.col("text")))
    return made.select(key, F.col("vec").cast("array<double>").alias("vec"))


# The same over all documents, with or without a row in the embeddings table. Vectors are hashed from idf-weighted
# terms: words that every text of a language holds bring no two texts near, so that the threshold is selective.
DENSE_WIDTH = 256
ENCODED_SQL = f"""{tfidf_sql()},
dv AS (SELECT doc_id, m % {DENSE_WIDTH} AS dim, sum(CASE WHEN m // {DENSE_WIDTH} % 2 = 1 THEN weight ELSE -weight END) AS x
  FROM (SELECT doc_id, weight, CAST('0x' || left(md5(term), 8) AS BIGINT) AS m FROM tfidf) GROUP BY 1, 2),
text_sims AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.weight * b.weight) AS tfidf
  FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2),
dv_unit AS (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM dv),
dense_sims AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.x * b.x) AS dense
  FROM dv_unit a JOIN dv_unit b ON a.dim = b.dim AND a.doc_id < b.doc_id GROUP BY 1, 2),
blend AS (
  SELECT id_a, id_b, da.lang AS lang_a, db.lang AS lang_b, coalesce(tfidf, 0) AS tfidf, coalesce(dense, 0) AS dense,
         0.65 * coalesce(dense, 0) + 0.35 * coalesce(tfidf, 0) AS hybrid
  FROM dense_sims FULL JOIN text_sims USING (id_a, id_b)
  JOIN documents da ON da.doc_id = id_a JOIN documents db ON db.doc_id = id_b)"""


def hybrid_encoded(spark: SparkSession, sf: str, at_least: float, kinds: DataFrame | None = None) -> DataFrame:
    weights = cut_lineage(tfidf.tfidf(documents(spark, sf), numbers=True).select("doc_id", "term", "no", "weight"))
    hashed = encoders.hashed_weights(weights, "doc_id", width=DENSE_WIDTH)
    vectors = encoders.unit_from_counts(hashed, "doc_id", DENSE_WIDTH, "double").toDF("item_id", "embedding")
    stock = cut_lineage(vectors.withColumns({"code": F.lit(""), "section": F.lit("")}))
    return pairs.hybrid_pairs(weights, stock, at_least, kinds=kinds)


@query(
    "hybrid_similarity_all",
    f"WITH {ENCODED_SQL} SELECT id_a, id_b, round(hybrid, 6) AS hybrid FROM blend WHERE hybrid >= 0.2",
)
def _hybrid_similarity_all(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_encoded(spark, sf, 0.2).select("id_a", "id_b", F.round("hybrid", 6).alias("hybrid"))


@query(
    "pair_self_join_all",
    f"""WITH {ENCODED_SQL}
SELECT lang_a AS lang, id_a, id_b, round(tfidf, 6) AS tfidf, round(dense, 6) AS dense, round(hybrid, 6) AS hybrid
FROM blend WHERE hybrid >= 0.15 AND lang_a = lang_b""",
)
def _pair_self_join_all(spark: SparkSession, sf: str) -> DataFrame:
    return same_language(hybrid_encoded(spark, sf, 0.15, languages(spark, sf)))


@query(
    "two_stage_single",
    f"""WITH {ASKED_SQL},{vectors_sql("dv", "doc_id", "documents")},
asked AS (SELECT item_id AS query_id, text FROM benchmark),{vectors_sql("qv", "query_id", "asked")},
scored AS (SELECT t.query_id, t.doc_id, coalesce(sum(q.x * d.x), 0.0) AS sim
  FROM top t LEFT JOIN qv q ON q.query_id = t.query_id LEFT JOIN dv d ON d.doc_id = t.doc_id AND d.dim = q.dim
  WHERE t.rn <= 100 GROUP BY ALL)
SELECT query_id, doc_id, CAST(rn AS INT) AS pos, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rn FROM scored)
WHERE rn <= 10""",
)
def _two_stage_single(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as query documents; both sides are encoded from their text."""
    docs, asked = documents(spark, sf), benchmark_queries(spark, sf)
    found = two_stage.two_stage(docs, asked, text_vectors(asked, "query_id"), text_vectors(docs, "doc_id"))
    return found.select("query_id", "doc_id", "pos", F.round("sim", 6).alias("sim"))


TAKEN_DOCS_SQL = """
taken_docs AS (SELECT DISTINCT h.user_id, d.doc_id FROM history h JOIN items i USING (code)
               JOIN documents d ON d.doc_id = i.item_id)"""


def taken_docs(spark: SparkSession, sf: str) -> DataFrame:
    mine = profiles.taken_items(history(spark, sf), items(spark, sf))
    docs = documents(spark, sf).select("doc_id")
    return mine.select("user_id", F.col("item_id").alias("doc_id")).join(docs, "doc_id", "left_semi")


@query(
    "concat_user_text",
    f"""WITH {ITEMS},{HISTORY},{TAKEN_DOCS_SQL}
SELECT user_id, string_agg(text, ' ' ORDER BY doc_id) AS text FROM taken_docs JOIN documents USING (doc_id)
GROUP BY user_id""",
)
def _concat_user_text(spark: SparkSession, sf: str) -> DataFrame:
    return two_stage.user_text(taken_docs(spark, sf), documents(spark, sf))


# Fitted anew for every user: the corpus without the taken documents, plus the joined text.
PROFILE_SQL = f"""{BASE},{TAKEN_DOCS_SQL},
texts AS (SELECT user_id AS doc_id, string_agg({clean_sql()}, ' ' ORDER BY doc_id) AS text
          FROM taken_docs JOIN documents USING (doc_id) GROUP BY user_id),
{counts_sql()},{counts_sql("texts", name="mine")},
sizes AS (SELECT user_id, (SELECT count(*) FROM documents) - count(*) + 1 AS n FROM taken_docs GROUP BY user_id),
df_all AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
df_out AS (SELECT user_id, term, count(*) AS df FROM taken_docs JOIN counts USING (doc_id) GROUP BY user_id, term),
fits AS (
  SELECT s.user_id, c.doc_id, c.term, c.tf, s.n,
         a.df - coalesce(o.df, 0) + CASE WHEN m.term IS NULL THEN 0 ELSE 1 END AS df
  FROM sizes s CROSS JOIN counts c JOIN df_all a USING (term)
  LEFT JOIN df_out o ON o.user_id = s.user_id AND o.term = c.term
  LEFT JOIN mine m ON m.doc_id = s.user_id AND m.term = c.term
  ANTI JOIN taken_docs t ON t.user_id = s.user_id AND t.doc_id = c.doc_id),
doc_w AS (SELECT user_id, doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
          FROM fits WHERE df >= 2 AND df <= 0.85 * n),
doc_len AS (SELECT user_id, doc_id, sqrt(sum(w * w)) AS len FROM doc_w GROUP BY user_id, doc_id),
mine_df AS (
  SELECT m.doc_id AS user_id, m.term, m.tf, s.n, coalesce(a.df, 0) - coalesce(o.df, 0) + 1 AS df
  FROM mine m JOIN sizes s ON s.user_id = m.doc_id LEFT JOIN df_all a USING (term)
  LEFT JOIN df_out o ON o.user_id = m.doc_id AND o.term = m.term),
mine_w AS (SELECT user_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
           FROM mine_df WHERE df >= 2 AND df <= 0.85 * n),
mine_len AS (SELECT user_id, sqrt(sum(w * w)) AS len FROM mine_w GROUP BY user_id),
sims AS (SELECT d.user_id, d.doc_id, sum(d.w * m.w) AS product FROM doc_w d JOIN mine_w m USING (user_id, term)
         GROUP BY d.user_id, d.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, doc_id) AS rn
        FROM (SELECT s.user_id, s.doc_id, s.product / (dl.len * ml.len) AS sim
              FROM sims s JOIN doc_len dl USING (user_id, doc_id) JOIN mine_len ml USING (user_id)))"""


@query(
    "profile_text_topn",
    f"""WITH {PROFILE_SQL}
SELECT user_id, doc_id, CAST(rn AS INT) AS pos, round(sim, 6) AS sim FROM top WHERE rn <= 100""",
)
def _profile_text_topn(spark: SparkSession, sf: str) -> DataFrame:
    found = two_stage.profile_topn(documents(spark, sf), taken_docs(spark, sf), 100)
    return found.select(
        F.col("query_id").alias("user_id"), "doc_id", "pos", F.round("sim", 6).alias("sim")
    )


@query(
    "two_stage_profile",
    f"""WITH {PROFILE_SQL},{vectors_sql("dv", "doc_id", "documents")},{vectors_sql("qv", "doc_id", "texts")},
scored AS (SELECT t.user_id, t.doc_id, coalesce(sum(q.x * d.x), 0.0) AS sim
  FROM top t LEFT JOIN qv q ON q.doc_id = t.user_id LEFT JOIN dv d ON d.doc_id = t.doc_id AND d.dim = q.dim
  WHERE t.rn <= 100 GROUP BY ALL)
SELECT user_id, doc_id, CAST(rn AS INT) AS pos, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 12) DESC, doc_id) AS rn
      FROM scored WHERE sim < 0.999999) WHERE rn <= 10""",
)
def _two_stage_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A user's vector is that of their joined text: the sum of the signed counts of what they took."""
    docs, taken = documents(spark, sf), taken_docs(spark, sf)
    tokens = docs.select("doc_id", F.explode_outer(tx.tokens(F.col("text"))).alias("token"))
    counts = cut_lineage(encoders.hashed_counts(tokens, "doc_id"))
    summed = taken.join(counts, "doc_id").groupBy("user_id", "dim").agg(F.sum("x").alias("x"))
    vectors = [encoders.unit_from_counts(c, k).select(k, F.col("vec").cast("array<double>").alias("vec")) for c, k in ((summed, "user_id"), (counts, "doc_id"))]
    found = two_stage.two_stage_profile(docs, taken, *vectors)
    return found.select(
        F.col("query_id").alias("user_id"), "doc_id", "pos", F.round("sim", 6).alias("sim")
    )


# ---- incremental work ---------------------------------------------------------------


@query(
    "append_rows",
    """SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark""",
)
def _append_rows(spark: SparkSession, sf: str) -> DataFrame:
    extra = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    return documents(spark, sf).withColumnRenamed("doc_id", "id").unionByName(extra)


@query(
    "anti_unseen_texts",
    """SELECT conv_id, turn, text FROM conversations c ANTI JOIN documents d ON d.text = c.text""",
)
def _anti_unseen_texts(spark: SparkSession, sf: str) -> DataFrame:
    fresh = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return ingest.unseen_texts(fresh, documents(spark, sf))


@query(
    "anti_unseen_deduped",
    """SELECT min(doc_id) AS doc_id, text FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id GROUP BY text""",
)
def _anti_unseen_deduped(spark: SparkSession, sf: str) -> DataFrame:
    """Documents still without a label, each text once (the batch is deduplicated too)."""
    docs = documents(spark, sf)
    done = table(spark, sf, "labels").select("doc_id")
    return ingest.first_of_text(docs.join(done, "doc_id", "left_anti"), "doc_id")
