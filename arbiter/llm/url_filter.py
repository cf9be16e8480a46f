"""URL filters: longest-rule verdicts by a sorted sweep over reversed hosts, in DataFrame operations only.

A host is written with its labels reversed and a dot after each
(``www.example.com`` is ``com.example.www.``), so that the hosts under a rule's
host are one interval of the sorted keys, and rules with equally many labels
never overlap.  The sweep runs over the sorted union of rule hosts and distinct
URL hosts and holds one slot per label count: the last rule host of that depth.
A slot is on the stack of active rules as long as its key begins the current
key, so nested rules need no end events.  The sweep is dealt out by key range;
each range starts from the slots that the ranges before it leave behind, one
row per range.  Only distinct hosts are sorted.  The paths of the few rule
hosts on the stack are then tested against each URL.

Edge cases: a null url, or one without ``://``, has an empty host and path and
no rule; a host is kept as written apart from A-Z (ports and user names stay);
repeated urls and pages are judged row by row; equal rules with both verdicts
block; without a rule the verdict is ``default``; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.llm.common import shuffle_width, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULES_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of all rule hosts that cover it; hosts without any are left out."""
    spark = hosts.sparkSession
    by_host = (
        rules.where("host is not null and path is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host")
        .agg(F.collect_set(F.struct("path", "verdict")).alias("paths"))
        .select(
            host_key(F.col("host")).alias("key"),
            F.struct(host_key(F.col("host")).alias("key"), F.col("host"), F.col("paths")).alias("rule"),
        )
        .withColumn("depth", F.size(F.split("key", r"\.")) - 1)
    )
    depths = sorted(r[0] for r in by_host.select("depth").distinct().collect())
    slots = [f"slot{d}" for d in depths]
    if not depths:
        return hosts.where("false").select("host", F.array().cast("array<struct<host:string,path:string,verdict:string>>").alias("rules"))
    rule_events = by_host.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
        *(F.when(F.col("depth") == d, F.col("rule")).alias(s) for d, s in zip(depths, slots, strict=True)),
    )
    kind = rule_events.schema[slots[0]].dataType
    probes = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", *(F.lit(None).cast(kind).alias(s) for s in slots))
    width = shuffle_width(spark)
    events = written(
        probes.unionByName(rule_events).repartitionByRange(width, "key").withColumn("part", F.spark_partition_id()), "url-events"
    )
    # What is open where a range begins: the last rule host of each depth in the ranges before it.
    left = events.groupBy("part").agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("key"))).alias(s) for s in slots))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    seeds = left.select("part", F.lit("").alias("key"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("host"), *(F.last(s, ignorenulls=True).over(earlier).alias(s) for s in slots))
    sweep = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = events.unionByName(seeds).select("key", "kind", "host", *(F.last(s, ignorenulls=True).over(sweep).alias(s) for s in slots))
    stack = F.filter(F.array(*slots), lambda s: s.isNotNull() & F.startswith(F.col("key"), s["key"]))
    flat = F.flatten(F.transform(stack, lambda s: F.transform(s["paths"], lambda p: F.struct(s["host"].alias("host"), p["path"].alias("path"), p["verdict"].alias("verdict")))))
    return swept.where("kind = 1").select("host", flat.alias("rules")).where(F.size("rules") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, payload: Column | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict) per page; ``row`` is ``payload``, by default all columns.

    A hot host is one row on the rules' side; adaptive execution splits its
    pages on the other side of the join.
    """
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in pages.columns))
    url = F.col(f"`{url_col}`")
    parsed = pages.select(payload.alias("row"), url_host(url).alias("host"), url_path(url).alias("path"))
    active = active_rules(parsed.select("host").where("host <> ''").distinct(), rules)
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fits,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("length"), F.length(r["host"]).alias("labels"), r["verdict"].alias("verdict"),
            F.concat(r["host"], r["path"]).alias("rule"),
        ),
    )
    # Longest rule, then the longer host; of equal rules 'block' sorts after 'allow'.
    best = F.array_max(ranked)
    return (
        parsed.join(active, "host", "left")
        .withColumn("best", best)
        .select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, RULES_SCHEMA)
    return judge_urls(pages, rules, F.col("page_id")).withColumnRenamed("row", "page_id")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT n, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (n)
"""
