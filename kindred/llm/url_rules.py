"""URL filters by hashed host-suffix and path-prefix expressions.

Every URL stands for the expressions `suffix of its host` + `prefix of its path`. Expressions and
rules meet in an equi-join on the first bytes of their SHA-256; the full digest confirms, and the
longest rule decides. Only suffixes of as many labels, and prefixes of as many characters, as some
rule has are made; nothing else could match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ascii_lower
from kindred.session import broadcast_if_fits

PREFIX_HEX = 8
RULE_BYTES = 400


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def parse_rules(rules: DataFrame) -> DataFrame:
    """``rule`` (host + path) and ``action`` with digest, length, host labels and path length.

    A null rule or action is no rule; of equal rules ``block`` wins.
    """
    host = F.substring_index("rule", "/", 1)
    return (
        rules.where(F.col("rule").isNotNull() & F.col("action").isin("allow", "block"))
        .groupBy("rule")
        .agg(F.max("action").alias("action"))
        .select(
            "rule",
            "action",
            _digest(F.col("rule")).alias("rule_digest"),
            F.length("rule").alias("rule_length"),
            F.length(host).alias("host_length"),
            F.size(F.split(host, r"\.")).alias("labels"),
            (F.length("rule") - F.length(host)).alias("path_length"),
        )
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's path; the rule
    with most characters wins, then the one with the longer host. Without a rule the verdict is
    ``default``. A null or malformed URL has an empty host and path and fits no rule. Equal URLs
    are judged once; rows are never merged, so equal or null ``page_id`` stay. Other columns are
    ignored; no rows give no rows; without rules every verdict is ``default``.
    """
    known = parse_rules(rules)
    # Distinct sizes only: at most one row per possible label count and path length.
    sizes = known.select("labels", "path_length").distinct().collect()
    labels = sorted({r["labels"] for r in sizes}) or [1]
    lengths = sorted({r["path_length"] for r in sizes}) or [0]

    located = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = located.select("host", "path").where(F.col("host") != "").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size("parts") >= n, F.array_join(F.slice("parts", -n, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    expressions = (
        places.withColumn("parts", parts)
        .select("host", "path", F.explode(F.array_compact(suffixes)).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode(F.array_compact("prefixes")).alias("prefix"))
        .select("host", "path", F.concat("suffix", "prefix").alias("expression"))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("short", F.left("digest", F.lit(PREFIX_HEX)))
    )
    short_rules = broadcast_if_fits(known.withColumn("short", F.left("rule_digest", F.lit(PREFIX_HEX))), RULE_BYTES)
    decided = (
        expressions.join(short_rules, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), F.struct("rule_length", "host_length")).alias("won"))
        .select("host", "path", "won.rule", "won.action")
    )
    # Rows without a host fit no rule. They would share one key of the join, so they are dealt by id and path instead.
    apart = F.when(F.col("host") == "", F.xxhash64("page_id", "path")).otherwise(F.lit(0).cast("long"))
    return located.withColumn("apart", apart).join(decided.withColumn("apart", F.lit(0).cast("long")), ["host", "path", "apart"], "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
