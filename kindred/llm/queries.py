"""The operators of this package bound to the driver's tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    bpe_tree,
    byte_cnn,
    cover_topk,
    crf_langid,
    host_quality,
    importance_resampling,
    line_dedup,
    minhash_paths,
    partition_jaccard,
    prefix_trie,
    pu_toxicity,
    url_rules,
    vector_packing,
)
from kindred.llm.common import fold
from kindred.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = line_dedup.dedupe(table(spark, sf, "documents"))
    return cut.select(
        "doc_id",
        F.size("line_equal").alias("n_equal"),
        F.size("line_near").alias("n_near"),
        F.length(F.coalesce("line_text", F.lit(""))).alias("chars_left"),
        F.md5(F.coalesce("line_text", F.lit(""))).alias("text_md5"),
    )


# The rules of the URL filter query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


@query(
    r"""
    WITH rules(rule, action) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'),
           ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
    cut AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
    placed AS (SELECT page_id, url,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                   AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
               FROM cut),
    decided AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
                FROM (SELECT DISTINCT host, path FROM placed) p JOIN rules
                  ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1))
                 AND starts_with(path, substr(rule, instr(rule, '/')))
                GROUP BY host, path)
    SELECT page_id, url, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM placed LEFT JOIN decided USING (host, path)"""
)
def op2_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_rules.judge(table(spark, sf, "pages"), rules, default="allow")


@query(
    r"""
    WITH docs AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
                    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) > 2),
    windows AS (SELECT doc_id, i, words[i:i + 2] AS w FROM spots),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows)
              WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
             WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (SELECT doc_id, host, len(words)::BIGINT AS n_words,
            length(array_to_string(words, ''))::BIGINT AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(n_lines, 0) AS n_lines, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
          FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2,
            n_symbols > 0.1::DOUBLE * n_words AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (f1) AS c1, count(*) FILTER (f2) AS c2,
                count(*) FILTER (f3) AS c3, count(*) FILTER (f4) AS c4 FROM f GROUP BY host),
    rates AS (SELECT host, n, unnest([c1, c2, c3, c4]) AS c, unnest([1, 2, 3, 4]) AS r FROM hosts),
    prior AS (SELECT r, sum(c) / sum(n) AS m, sum(c * c / n) / sum(n) AS q, count(*) / sum(n) AS h FROM rates GROUP BY r),
    weight AS (SELECT r, m, CASE WHEN q - m * m - m * (1 - m) * h > 0
                 THEN greatest(1, m * (1 - m) / (q - m * m - m * (1 - m) * h) - 1) ELSE 1 END AS s FROM prior),
    strict AS (SELECT host, max((c + s * m) / (n + s)) > 0.5 AS strict FROM rates JOIN weight USING (r) GROUP BY host)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
      NOT (f1 OR f2) AND NOT (strict AND (f3 OR f4)) AS kept
    FROM f JOIN strict ON f.host IS NOT DISTINCT FROM strict.host"""
)
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("host"))
    return host_quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0),
    sets AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM spots),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b USING (s)
            WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
              WHERE 100 * met.n >= 85 * (p.n + q.n - met.n)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x)
              SELECT x, min(y) AS y FROM r GROUP BY x)
    SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least(y, doc_id), doc_id) AS component_id,
      doc_id = coalesce(least(y, doc_id), doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON x = doc_id"""
)
def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_paths.near_duplicates(table(spark, sf, "documents"))


@query()
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    field = crf_langid.fit_field(docs.where(fold("doc_id", 3) != 1))
    return crf_langid.label(docs, field).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query()
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, seen = table(spark, sf, "documents"), fold("doc_id", 3) != 1
    labels = table(spark, sf, "labels").where(seen).select("doc_id", F.col("quality").alias("label"))
    network = byte_cnn.fit_network(docs.where(seen), labels)
    return byte_cnn.score(docs, network).select(
        "doc_id", (~seen).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op7_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_tree.decode(bpe_tree.encode(table(spark, sf, "documents"), ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, seen = table(spark, sf, "documents"), fold("doc_id", 4) != 2
    labels = table(spark, sf, "labels").where(seen)
    prior = pu_toxicity.class_prior(labels.select("doc_id", F.col("toxic").alias("label")))
    models = pu_toxicity.fit_models(docs.where(seen), labels.where("toxic = 1").select("doc_id"), prior)
    return pu_toxicity.score(docs, models).select(
        "doc_id", (~seen).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query(
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
                 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
    scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
               FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5"""
)
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return cover_topk.search(table(spark, sf, "embeddings"), every=50, k=5)


@query()
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = vector_packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# CRC-32 in SQL, by bytes and a computed table.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``; ``tab`` of CRC_TABLE must be in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)))"


@query(
    rf"""
    WITH {CRC_TABLE},
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
    bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
    placed AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
    s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN placed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN placed USING (w) GROUP BY bucket),
    gain AS (SELECT w, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
             FROM placed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN gain USING (w) GROUP BY doc_id),
    scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                 (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                   / 4294967296::DOUBLE))))::BIGINT AS score
               FROM d LEFT JOIN weights USING (doc_id)),
    able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
               10 * count(*) OVER () // 100 AS wanted FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END::BIGINT AS rank
    FROM scored LEFT JOIN able USING (doc_id)"""
)
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    f"""
    WITH {CRC_TABLE},
    t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
            {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT c, list(said ORDER BY pos) AS l FROM t GROUP BY c),
    hashed AS (SELECT c, l, ({crc_sql("c::VARCHAR")} % 6)::INT AS h FROM lists, crc),
    built AS (SELECT a.c, list_concat(coalesce(b.l, [])[1:h], a.l[h + 1:]) AS l FROM hashed a LEFT JOIN lists b ON b.c = a.c - a.c % 100),
    prefixes AS (SELECT c, l, d FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
    nodes AS (SELECT l[1:d] AS p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(coalesce(length(l[d].text), 0)) AS chars,
                sha256(coalesce(array_to_string(list(c ORDER BY c) FILTER (d = len(l)), ','), '')) AS ends_sha256
              FROM prefixes GROUP BY ALL),
    kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
    below AS (SELECT p[1:a] AS p, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
              FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM own) GROUP BY 1)
    SELECT own.conv_id, own.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children,
      leaves AS n_leaves, saved::BIGINT AS saved_tokens, own.ends_sha256
    FROM own JOIN below USING (p) LEFT JOIN nodes up ON own.depth > 0 AND up.p = own.p[1:own.depth - 1]"""
)
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf, "conversations"))


@query(
    r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0),
    sets AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM spots),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b USING (s)
            WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
              WHERE 100 * met.n >= 90 * (p.n + q.n - met.n)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x)
              SELECT x, min(y) AS y FROM r GROUP BY x)
    SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least(y, doc_id), doc_id) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON x = doc_id"""
)
def op13_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return partition_jaccard.similar(table(spark, sf, "documents"))
