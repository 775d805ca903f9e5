"""URL filters as a sort-merge range join.

A rule (host, path) becomes the interval of all keys that begin with
``reversed host / path``; these intervals are nested or apart.  A url is looked
up under its host and each of that host's parent domains (as many points as
labels), so a rule that covers a host also covers its subdomains.  Points and
interval ends are sorted together by key and swept once: a rule's start makes
it the active one, its end makes the rule around it active again, so the last
such event before a point tells the top of the stack of open rules there.  Of
a url's points the longest rule wins.

The sweep is distributed: the sorted events are cut into ranges of rows
(frequent hosts spread over many of them), each range is swept by a window, and
what was active at its begin comes from a table with one row per range.  Only
distinct (host, path) pairs take part.  DataFrame operations only.

Edge cases: a null url, or one without ``://``, has an empty host and path; no
rule fits it.  An empty path starts with no rule's path but the empty one.  An
empty table of rules gives every url the default verdict; of equal rules with
different verdicts ``block`` holds; rules with a null host, path or verdict are
ignored; repeated urls are judged alike; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name
from tabsmith.session import cut_lineage

LAST = "\U0010ffff"  # sorts after every key that begins with what stands before it


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; columns of these names are replaced."""
    url = F.coalesce(F.col(q(url_col)), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    base = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(base, r"(?s)^([^/]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": low, "path": F.substring(base, F.length(host) + F.lit(1), F.length(base))})


def canonical(host, path):
    """Key of a host and a path: the labels from the last to the first, a byte below any label, the path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x02"), F.lit("\x01"), path)


def parents(host):
    """A host and its parent domains, as an array (empty for an empty host)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), ".")))


def rule_events(rules: DataFrame) -> DataFrame:
    """``key, kind, rule, verdict, active``: per rule a start (kind 1), and an end (kind 0) that hands back to the rule around it."""
    r = (rules.select("host", "path", "verdict").dropna()
         .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block")))
    r = r.select("host", "path", F.concat("host", "path").alias("rule"),
                 F.when(F.col("block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    # the rule around it: the longest shorter prefix of its path that is a rule of the same host
    shorter = r.filter(F.length("path") > 0).select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path") - 1), lambda k: F.substring(F.col("path"), F.lit(1), k))).alias("outer"))
    around = (shorter.join(r.select("host", F.col("path").alias("outer"), "rule", "verdict"), ["host", "outer"])
              .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.length("outer")).alias("around")))
    r = r.join(around, ["host", "path"], "left")
    key = canonical(F.col("host"), F.col("path"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    # an event's value is wrapped, so that "no rule" isn't taken for "no event"
    start = F.struct(key.alias("key"), F.lit(1).alias("kind"), F.struct(F.struct("rule", "verdict").alias("top")).alias("event"))
    end = F.struct(F.concat(key, F.lit(LAST)).alias("key"), F.lit(0).alias("kind"), F.struct(F.coalesce("around", none).alias("top")).alias("event"))
    return r.select(F.explode(F.array(start, end)).alias("e")).select("e.*")


def sweep(points: DataFrame, events: DataFrame) -> DataFrame:
    """``points`` (with ``key``) with ``top``: the innermost rule whose interval holds the key."""
    value = events.schema["event"].dataType.simpleString()
    columns = [c for c in points.columns if c != "key"]
    both = points.select("key", F.lit(2).alias("kind"), F.lit(None).cast(value).alias("event"), *columns).unionByName(
        events, allowMissingColumns=True)
    order = ["key", "kind", *columns]
    ranged = cut_lineage(both.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    last = (ranged.filter("kind < 2").groupBy("range").agg(F.max_by("event", F.struct("key", "kind")).alias("event"))
            .unionByName(ranged.select("range").distinct().withColumn("event", F.lit(None).cast(value)))
            .groupBy("range").agg(F.first("event", ignorenulls=True).alias("event")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    begin = last.select("range", F.last("event", ignorenulls=True).over(before).alias("begin"))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("event", F.last("event", ignorenulls=True).over(upto)).filter("kind = 2")
    return (swept.join(F.broadcast(begin), "range", "left")
            .select(*columns, F.coalesce("event", "begin")["top"].alias("top")))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest rule that fits (or null) and its verdict (or ``default``).

    ``rules``: ``host, path, verdict`` (allow or block)."""
    d = with_host_and_path(pages, url_col)
    pairs = d.select("host", "path").filter(F.length("host") > 0).distinct()
    points = pairs.select("host", "path", F.explode(parents(F.col("host"))).alias("domain"))
    points = points.select(canonical(F.col("domain"), F.col("path")).alias("key"), "host", "path")
    found = sweep(points, rule_events(rules)).filter("top is not null")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("length"), F.col("top"))).alias("best"))
    h, p, top = (free_name(x, d) for x in ("__h", "__p", "__top"))  # names that the pages don't have
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best.top").alias(top))
    out = d.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    keep = [c for c in d.columns if c.lower() not in ("rule", "verdict")]
    return out.select(*[F.col(q(c)) for c in keep], F.col(top)["rule"].alias("rule"),
                      F.coalesce(F.col(top)["verdict"], F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules from (``host/path``, verdict) pairs."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"),
                     F.lit(v).alias("verdict")) for r, v in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
