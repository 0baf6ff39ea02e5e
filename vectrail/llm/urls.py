"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # hex digits of a digest that make the short prefix: 4 bytes


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a rule table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lowered; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes at label borders, each with every path prefix of a length that some rule has."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: ``id_col, host, path, rule, verdict``.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
    rule's path. The longest rule wins: most characters in host and path together, then the longer
    host, then block before allow. A url that no rule fits, null or without ``://`` (host and path
    empty) gets ``default`` and a null rule. Rules with a null part are ignored. Repeated rows get a
    row each; null ids are passed on; other columns are ignored. No rows give no rows.

    Rules are joined on the short prefix of the expression's digest, then the whole digest decides.
    Rows of the same id and url are combined first, and only that key is shuffled: matching rules
    collapse under it before the shuffle's result is used, so a host of a third of all pages is no
    hot key. Spark broadcasts the rules if their size allows and otherwise joins by shuffle.
    """
    usable = rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    usable = usable.where("r_host is not null and r_path is not null and r_verdict is not null").distinct()
    lengths = [r.n for r in usable.select(F.length("r_path").alias("n")).distinct().collect()]
    keyed = usable.withColumn("r_rule", F.concat("r_host", "r_path")).withColumn("r_digest", digest(F.col("r_rule")))
    keyed = keyed.withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.groupBy("id", "url").agg(F.count("*").alias("copies"))
    parts = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    asked = parts.select("*", F.explode_outer(F.array_distinct(expressions(F.col("host"), F.col("path"), lengths))).alias("expression"))
    asked = asked.withColumn("digest", digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    found = asked.join(keyed, "prefix", "left")
    # A rule must fit as (host, path), not only as their concatenation.
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    fits &= (F.col("host") == F.col("r_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("r_host")))
    rank = F.when(
        fits,
        F.struct(
            F.length("r_rule").alias("length"),
            F.length("r_host").alias("host_length"),
            F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.col("r_rule").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        ),
    )
    best = found.groupBy("id", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best")
    )
    out = best.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")
