"""URL filters as a sort-merge range join, in DataFrame operations only.

A host is read from its end: ``blog.example.net`` becomes ``net.example.blog.``. A rule's host becomes the same kind of
key, and "this host and all its subdomains" becomes the interval of keys that start with it. Such intervals nest or are
disjoint, so a sweep over the sorted keys needs a stack only: a rule's opening event carries the stack of all rules open
from there on, its closing event the stack below it, and a url reads the last event before it. The rules of the stack
whose path begins the url's path fit; the longest wins.

Urls and events are dealt by ranges of (key, url id, row number), so that one host may hold any share of the rows, and
written; one small row per range carries the open stack into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.llm.common import ascii_lower, partitions, written

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
STACK = "array<struct<path:string,rule:string,verdict:string>>"


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def host_key(host: Column) -> Column:
    """Labels from the end, each closed by a dot; the closing dot makes a prefix end at a label's end."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack): where the set of open rules changes, and the rules open from there on, outermost first."""
    kept = rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
    kept = kept.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    kept = kept.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    entry = F.struct("path", F.concat("host", "path").alias("rule"), "verdict")
    hosts = kept.groupBy(host_key(F.col("host")).alias("key")).agg(F.sort_array(F.collect_list(entry)).alias("own"))
    labels = F.slice(F.split("key", r"\."), F.lit(1), F.size(F.split("key", r"\.")) - 1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(".", F.slice(labels, F.lit(1), n)), F.lit("."))
    )
    chain = (
        hosts.select(F.col("key").alias("inner"), F.explode(above).alias("key"))
        .join(hosts, "key")
        .groupBy("inner")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("key").alias("depth"), "key", "own"))).alias("chain"))
    )
    opened = F.flatten(F.col("chain.own"))
    below = F.flatten(F.filter("chain", lambda c: c.key != F.col("inner")).own)
    after = F.concat(F.expr("substring(inner, 1, length(inner) - 1)"), F.lit("/"))  # "/" follows "." in byte order
    return chain.select(F.col("inner").alias("key"), opened.cast(STACK).alias("stack")).unionByName(
        chain.select(after.alias("key"), below.cast(STACK).alias("stack"))
    )


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The verdict of the longest rule that fits each url: (id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has host, path and verdict. Null url or no ``://``: empty host and path, so no rule fits. No rule: null and
    ``default``. Null ids and repeated rows stay. Rules without host or verdict are left out; a null path is the empty
    path; of two verdicts for one rule the later in the alphabet (block) holds. Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    events = rule_events(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast(pages.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    points = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "row", "id", "host", "path", F.lit(None).cast(STACK).alias("stack"))
    dealt = written(
        events.unionByName(points).repartitionByRange(n, "key", "kind", "row").withColumn("part", F.spark_partition_id()), "url-ranges"
    )
    ends = dealt.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("own"))
    carried = (
        spark.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
        .withColumn("stack", F.last("own", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .filter("stack is not null")
        .select("part", F.lit("").alias("key"), F.lit(0).alias("kind"), "stack")
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(carried, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("open", lambda r: F.col("path").startswith(r.path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r.rule).alias("size"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    return (
        swept.filter("kind = 1")
        .withColumn("best", best)
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
