"""URL block and allow lists, matched by hashed host-suffix and path-prefix expressions.

A rule is (verdict, host, path). It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's. Each URL is expanded into expressions (a suffix of its host at a
label border, followed by a prefix of its path at a segment border); those meet the rules on the
first four bytes of a SHA-256, and a match counts only if the whole digest and the rest
of the rule's path agree. Of the rules that fit, the longest wins.

Only expressions of the *shapes* the rules have (labels of the host, segments of the path) are made, so
a URL with thousands of labels costs no more than the rule list asks for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # of the hexadecimal digest: four bytes
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a rule table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _hashed(rules: DataFrame) -> DataFrame:
    """Rules with the digest of host + path up to its last ``/``; block wins over allow for one rule given twice."""
    known = (
        rules.select("verdict", "host", "path")
        .where("verdict IN ('allow', 'block') AND path IS NOT NULL AND host <> ''")
        .groupBy("host", "path")
        .agg(F.max((F.col("verdict") == "block").cast("long")).alias("block"))
    )
    folder = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    digest = F.sha2(F.concat("host", F.lit("\n"), folder), 256)
    return known.select(
        # ordered by precedence, and enough to tell rule and verdict from the url it fits
        (F.length(F.concat("host", "path")) * F.lit(1 << 32) + F.length("host") * 2 + F.col("block")).alias("rule"),
        F.col("path").alias("rule_path"),
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.size(F.split(folder, "/")) - 1).alias("segments"),
        digest.alias("rule_digest"),
        digest.substr(1, PREFIX_DIGITS).alias("rule_short"),
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict for every row of ``urls``.

    ``urls`` has ``page_id`` and ``url``; further columns are ignored, whatever their names. ``rules``
    is (verdict, host, path); a rule with a null part, an empty host or a verdict other than allow and
    block never fits. Returns
    page_id, host, path, rule (host + path of the winning rule, else null), verdict (``default`` if no
    rule fits). Precedence: longest host + path, then longest host; one host and path both
    allowed and blocked counts as blocked. A null url, or one without ``://``, has empty host
    and path and gets the default. Repeated rows and repeated or null ids are judged row by row.

    The rule list is broadcast up to BROADCAST_RULES rows; beyond that the join shuffles
    both sides and Spark may split a hot expression (adaptive skew join).
    """
    rules = _hashed(rules)
    counted = rules.groupBy("labels", "segments").count().collect()  # at most labels x segments rows
    shapes = [(r["labels"], r["segments"]) for r in counted]
    n_rules = sum(r["count"] for r in counted)

    rows = urls.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    )
    if not shapes:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    # F.size(parts) - 1 is the number of slashes; a shape beyond the url's own gives no expression
    expressions = [
        F.when(
            (F.col("host") != "") & (F.size(labels) >= n) & (F.size(parts) - 1 >= m),
            F.concat(
                F.substring_index("host", ".", -n),
                F.lit("\n"),
                F.substring_index("path", "/", m) if m else F.lit(""),
                F.lit("/" if m else ""),
            ),
        )
        for n, m in sorted(shapes)
    ]
    made = rows.withColumn("expression", F.explode(F.array_compact(F.array(F.lit(""), *expressions))))
    made = made.withColumn("digest", F.sha2("expression", 256)).withColumn(
        "short", F.col("digest").substr(1, PREFIX_DIGITS)
    )
    right = rules.select("rule", "rule_path", "rule_digest", "rule_short")
    if n_rules <= BROADCAST_RULES:
        right = F.broadcast(right)
    met = made.join(right, F.col("short") == F.col("rule_short"), "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(fits, F.col("rule"))).alias("best"))
    size = F.shiftright("best", 32).cast("int")
    host_size = F.shiftright(F.col("best").bitwiseAND(0xFFFFFFFF), 1).cast("int")
    rule = F.concat(F.right("host", host_size), F.left("path", size - host_size))
    by_rule = F.when(F.col("best").bitwiseAND(1) == 1, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(by_rule)
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
