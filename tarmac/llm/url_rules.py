"""URL filtering by host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every executor at most; more are joined by a shuffle, whose skew Spark splits.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the digest that are equi-joined; the full digest confirms.
PREFIX_DIGITS = 8


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``rule, verdict, labels, width, digest`` of rules (verdict, "host/path")."""
    made = [(verdict, rule) for verdict, rule in dict.fromkeys(rules)]
    table = spark.createDataFrame(made, "verdict string, rule string")
    return prepare_rules(table)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Adds the shape of each rule (host labels, width of its path) and its digest.

    Rules are text: the host up to the first /, and the path from there on. A rule given twice counts once; if its
    verdicts differ, block wins.
    """
    rules = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    at = F.instr("rule", "/")
    name = F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
    return rules.select("rule", "verdict", F.size(F.split(name, r"\.")).alias("labels"), (F.length("rule") - F.length(name)).alias("width"), F.sha2("rule", 256).alias("digest"))


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row of ``pages``.

    Each URL is expanded into the expressions host suffix + path prefix of the shapes that occur among the rules; these
    meet the rules by equality of a short prefix of their digests, the full digest confirms, and the longest rule wins
    (of equally long ones, the last in order of text). A page that no rule fits has a null rule and the default verdict.

    A null URL, or one without ``://``, has an empty host and path. Repeated rows stay as many rows. An empty table gives
    no rows; other columns are left out, so extra ones cannot clash.
    """
    shapes = rules.groupBy("labels").agg(F.collect_set("width").alias("widths"))  # a row for each number of host labels
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    pages = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    # Suffixes of n labels, each with the prefixes that rules of as many labels have. The suffix of none keeps pages that
    # have no other expression and counts repeated rows.
    depth = F.when(F.col("host") != "", F.size(F.split("host", r"\."))).otherwise(0)
    suffixes = pages.select("*", F.explode(F.sequence(F.lit(0), depth)).alias("n"))
    shaped = suffixes.join(F.broadcast(shapes) if small else shapes, F.col("n") == F.col("labels"), "left")
    fitting = F.filter(F.coalesce("widths", F.array().cast("array<int>")), lambda w: w <= F.length("path"))
    spread = shaped.select("page_id", "url", "host", "path", "n", F.explode(F.when(F.col("n") == 0, F.array(F.lit(0))).otherwise(fitting)).alias("width"))
    expression = F.when(F.col("n") > 0, F.expr("concat(substring_index(host, '.', -n), substring(path, 1, width))"))
    spread = spread.withColumn("full", F.sha2(expression, 256))
    known = rules.select("rule", F.col("verdict").alias("said"), "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("short"))
    met = spread.join(F.broadcast(known) if small else known, (F.substring("full", 1, PREFIX_DIGITS) == F.col("short")) & (F.col("full") == F.col("digest")), "left")
    best = met.groupBy("page_id", "url", "host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("size"), "rule", "said"))).alias("best"),
        F.count_if(F.col("n") == 0).alias("times"),
    )
    return best.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
