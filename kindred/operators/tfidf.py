"""TF-IDF as DataFrame aggregates over a long table ``(doc_id, term, …)``.

Weights follow the smooth formula ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)`` with unit
length per document.  Terms are single tokens and pairs of neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import tokens
from kindred.operators import products
from kindred.session import BROADCAST_BYTES, cut_lineage, fits, spread_width

# Similarities are ranked after rounding to this many digits: copies of a text tie.
RANK_DIGITS = 9
TERM_BYTES = 128


def grams(words: Column, pairs: bool = True) -> Column:
    """Tokens, and pairs of neighbours when asked for."""
    if not pairs:
        return words
    short = F.greatest(F.size(words) - 1, F.lit(0))
    neighbours = F.zip_with(
        F.slice(words, 1, short), F.slice(words, 2, short), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.when(F.size(words) > 1, F.concat(words, neighbours)).otherwise(words)


def term_counts(docs: DataFrame, pairs: bool = True, tokenizer=tokens) -> DataFrame:
    """``(doc_id, term, tf)``.

    The texts are spread by document first: that shuffle moves each text once, and the
    count per (document, term) then needs no shuffle of its own.
    """
    spread = docs.select("doc_id", "text").repartition(spread_width(docs), "doc_id")
    words = spread.select("doc_id", tokenizer(F.col("text")).alias("words"))
    exploded = words.select("doc_id", F.explode(grams(F.col("words"), pairs)).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(term, df, total)``; combined map-side, so a frequent term is one row per task."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def prune(frequency: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.85) -> DataFrame:
    return frequency.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def top_terms(frequency: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of the corpus; equal counts by term."""
    return frequency.orderBy(F.desc("total"), "term").limit(max_features)


def idf(df: Column, n_docs: int | Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def weigh(counts: DataFrame, frequency: DataFrame, n_docs: int) -> DataFrame:
    """``(doc_id, term, weight, df)`` at unit length, and ``no`` where the frequencies have it, partitioned by document."""
    raw = times_idf(counts, frequency, n_docs)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / length).alias("weight"), "df", *number_of(raw))


def number_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "no"]


def with_frequency(counts: DataFrame, frequency: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``counts`` of the terms in ``frequency(term, df)``, with ``df``.

    The most frequent terms, as many as are proven to fit, are broadcast: most counts then stay where they
    are, and no term that many documents hold is a key of the shuffle. Counts of the others meet by term.
    """
    known = cut_lineage(frequency.select("term", "df", *number_of(frequency)))
    if fits(known, TERM_BYTES, limit):
        return counts.join(F.broadcast(known), "term")
    # Terms by eighths of a power of two of their frequency: a bounded list, however many terms there are.
    step = F.floor(F.log2("df") * 8)
    left, border = limit // TERM_BYTES, None
    for row in sorted(known.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= row["count"]
        if left < 0:
            break
        border = row["step"]
    if border is None:
        return counts.join(known, "term")
    often = F.broadcast(known.where(step >= border))
    seldom = counts.join(often.select("term"), "term", "left_anti").join(known.where(step < border), "term")
    return counts.join(often, "term").unionByName(seldom)


def times_idf(counts: DataFrame, frequency: DataFrame, n_docs: int) -> DataFrame:
    """``(doc_id, term, df, raw)``: weights before they are brought to unit length."""
    found = with_frequency(counts, frequency)
    return found.select("doc_id", "term", "df", raw_weight(n_docs).alias("raw"), *number_of(found))


def raw_weight(n_docs: int) -> Column:
    """The weight of ``tf`` and ``df`` before a document is brought to unit length."""
    return (F.lit(1.0) + F.log(F.col("tf"))) * idf(F.col("df"), n_docs)


def tfidf(
    docs: DataFrame,
    pairs: bool = True,
    min_df: int = 2,
    max_df: float = 0.85,
    max_features: int | None = None,
    tokenizer=tokens,
    numbers: bool = False,
) -> DataFrame:
    """TF-IDF of ``docs(doc_id, text)``; ``n`` counts every document, empty ones too.

    The counts are written once, because the frequencies and the weights both read them. With ``numbers`` each
    weight has the number ``no`` of its term, from the join that brings the frequencies.
    """
    n_docs = docs.count()
    counts = cut_lineage(term_counts(docs, pairs, tokenizer))
    frequency = prune(document_frequency(counts), n_docs, min_df, max_df)
    if max_features is not None:
        frequency = top_terms(frequency, max_features)
    if numbers:
        frequency = frequency.withColumn("no", F.monotonically_increasing_id())
    return weigh(counts, frequency, n_docs)


def best_per_query(scored: DataFrame, n: int, digits: int = RANK_DIGITS) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", digits)), "doc_id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def one_per_text(docs: DataFrame, tokenizer=tokens) -> DataFrame:
    """Documents with the same tokens as one row: ``(doc_id, n_copies)``, empty ones dropped."""
    key = F.sha2(F.array_join(tokenizer(F.col("text")), " "), 256)
    return (
        docs.where(F.size(tokenizer(F.col("text"))) > 0)
        .groupBy(key.alias("text_key"))
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
        .select("doc_id", "n_copies")
    )


def similar_pairs(weights: DataFrame, at_least: float) -> DataFrame:
    """All ``(doc_a < doc_b, sim)`` with ``sim >= at_least``; no other pair leaves a task.

    Every block of documents meets every other (see ``products``): what is shuffled grows with the
    documents and the number of blocks, not with the pairs that share a term.
    """
    found = products.block_pairs(products.by_document(weights), at_least)
    return found.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"), F.col("text").alias("sim"))
