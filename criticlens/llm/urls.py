"""URL filters as a sort-merge range join over reversed-host keys.

A rule (host, path) holds for its host and every subdomain, for paths that start with its path. With
the labels of the host reversed ("org.example."), a host and its subdomains are one interval of
sorted keys, and so are the paths with a given prefix. Intervals of prefixes are nested or apart,
never crossing, so one sweep over sorted keys that keeps the stack of open intervals finds all rules
that hold. Two sweeps are made: distinct hosts against rule hosts, then distinct (rule host, path)
pairs against the paths of that host's rules.

Keys and interval bounds are sorted together by range, so no key space, host or rule set is gathered in
one task. All of it is DataFrame code.

Defined results: a NULL url, or one without "://", has an empty host and path; an empty path starts
with no rule's path; no rule gives rule NULL and the default verdict; among rules that hold the
longest (host and path together) wins, then the longer host, then the rule that sorts first; repeated urls
are judged alike; empty tables give empty results. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from criticlens.llm.ordered import PART, ranged
from criticlens.session import stage

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
SALTS = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sorts after every character of a key.
_LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """The part after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def reversed_host(host: Column) -> Column:
    """ "a.b.org" as "org.b.a." """
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Distinct ``key`` of ``points`` with the ``stack`` (outermost first) of the intervals that hold it.

    Opening bounds, keys and closing bounds are sorted together by range. The running count of open
    intervals is the height of the stack; the entry at height h is the last interval opened there.
    A range starts with the height and entries that the ranges before it leave. Keys under no
    interval are left out.
    """
    payload = intervals.schema["payload"].dataType
    nothing = F.lit(None).cast(payload)
    opening = intervals.select(F.col("low").alias("key"), F.lit(0).alias("kind"), "payload", F.lit(1).alias("step"))
    closing = intervals.select(F.col("high").alias("key"), F.lit(2).alias("kind"), nothing.alias("payload"), F.lit(-1).alias("step"))
    asked = points.select("key").distinct().select("key", F.lit(1).alias("kind"), nothing.alias("payload"), F.lit(0).alias("step"))
    rows = ranged(opening.unionByName(asked).unionByName(closing), [F.col("key"), F.col("kind")])

    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(PART).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.groupBy(PART).agg(F.sum("step").alias("_step"))
    base = steps.select(PART, F.coalesce(F.sum("_step").over(earlier), F.lit(0)).alias("_base"))
    height = (F.col("_base") + F.sum("step").over(so_far)).cast("int")
    rows = stage(rows.join(base, PART).select("key", "kind", "payload", PART, height.alias("height")))

    highest = rows.agg(F.max("height")).first()[0] or 0
    if not highest:
        return rows.select("key", F.array(nothing).alias("stack")).limit(0)
    entry = [F.when((F.col("kind") == 0) & (F.col("height") == h), F.struct("payload")) for h in range(1, highest + 1)]
    left = rows.groupBy(PART).agg(
        *[F.max_by(e, F.when(e.isNotNull(), F.col("key"))).alias(f"_left{h}") for h, e in enumerate(entry)]
    )
    left = left.select(PART, *[F.last(f"_left{h}", ignorenulls=True).over(earlier).alias(f"_open{h}") for h in range(highest)])
    inside = rows.select("key", "kind", "height", PART, *[F.last(e, ignorenulls=True).over(so_far).alias(f"_own{h}") for h, e in enumerate(entry)])
    levels = F.array(*[F.coalesce(f"_own{h}", f"_open{h}")["payload"] for h in range(highest)])
    return (
        inside.join(left, PART)
        .where((F.col("kind") == 1) & (F.col("height") > 0))
        .select("key", F.slice(levels, F.lit(1), F.col("height")).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    places = stage(urls.groupBy("host", "path").count().select("host", "path"))

    host_key = reversed_host(F.col("host"))
    host_rules = rules.select("host").distinct().select(
        host_key.alias("low"), F.concat(host_key, F.lit(_LAST)).alias("high"), F.col("host").alias("payload")
    )
    hosts = places.select("host").distinct().withColumn("key", host_key)
    over = sweep(hosts, host_rules).join(hosts, "key").select("host", F.explode("stack").alias("rule_host"))

    path_key = F.concat(reversed_host(F.col("rule_host")), F.col("path"))
    path_rules = rules.withColumnRenamed("host", "rule_host").select(
        path_key.alias("low"),
        F.concat(path_key, F.lit(_LAST)).alias("high"),
        F.struct(
            F.length(F.concat("rule_host", "path")).alias("length"),
            F.length("rule_host").alias("host_length"),
            F.concat("rule_host", "path").alias("rule"),
            "verdict",
        ).alias("payload"),
    )
    # A host may hold a third of all paths: its few rules are repeated, its paths spread.
    salted = places.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    over = over.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    reached = salted.join(over, ["host", "_salt"]).drop("_salt").withColumn("key", path_key)
    held = sweep(reached, path_rules).join(reached, "key").select("host", "path", F.array_max("stack").alias("best"))
    best = held.groupBy("host", "path").agg(F.max("best").alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
