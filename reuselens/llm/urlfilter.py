"""URL filters as a sort-merge range join, in DataFrame functions.

A rule (host, path) fits its host and all subdomains of it where the url's
path starts with the rule's. Canonical keys are ``reversed host ? path``: in
byte order the urls of a rule are the interval from its key to its key
followed by 0xFF. A url has one key for each of its host's ancestors (as far
as rules go), which covers subdomains.

Interval starts, interval ends and url keys are sorted together, range by
range, and swept in order. The number of rules that are active at a place is
the running sum of starts less ends, and as intervals nest, the innermost of
``d`` active rules is the last one whose start made the sum ``d``: slot ``d``
of the sweep's stack. Running sums and slots are carried from range to range
by tables of one row per range (and slot), so ranges are swept in parallel,
and many urls of one host just fill several ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"  # of a url that no rule fits
RULES = [  # contract of op6: verdict, host, path
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _labels(host: Column) -> Column:
    """Labels of a host from the last to the first; none of an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.", -1)))


def _key(labels: Column, path: Column) -> Column:
    # neither # nor ? can stand in a host or path
    return F.concat(F.concat_ws("#", labels), F.lit("?"), path).cast("binary")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule`` (host and path of
    the longest rule that fits, else null; of equally long ones that of the
    longer host) and ``verdict`` (the rule's, else ``default``).

    ``rules`` has ``verdict, host, path``; an empty host fits every url, rules
    with a null are none, and of equal rules with different verdicts the
    greater counts (block before allow). A null url, or one without ``://``,
    has an empty host and path. Null ids and repeated rows come back; an empty
    table gives no rows; other columns are not read."""
    rules = (rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .select(_key(_labels(F.col("host")), F.col("path")).alias("key"), F.size(_labels(F.col("host"))).alias("level"),
                     F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                              F.concat("host", "path").alias("rule"), "verdict").alias("rule")))
    rules = stage_table(rules, "rules")
    deepest = rules.agg(F.max("level")).first()[0] or 0

    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"),
                        url_host(url).alias("host"), url_path(url).alias("path"))
    labels = _labels(F.col("host"))
    # the key of level 0 brings the url's own columns, the others its row number only
    top = F.col("level") == 0
    points = urls.select("*", F.explode(F.sequence(F.lit(0), F.least(F.size(labels), F.lit(deepest)))).alias("level")).select(
        _key(F.slice(labels, F.lit(1), F.col("level")), F.col("path")).alias("key"), F.lit(1).alias("kind"), "row", "level",
        F.lit(0).alias("change"), F.when(top, F.col("page_id")).alias("page_id"), F.when(top, F.col("host")).alias("host"),
        F.when(top, F.col("path")).alias("path"))

    def edge(kind: int, change: int, key: Column) -> DataFrame:
        return rules.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit(-1).cast("bigint").alias("row"), "level",
                            F.lit(change).alias("change"), *([F.col("rule")] if kind == 0 else []))

    events = (points.unionByName(edge(0, 1, F.col("key")), allowMissingColumns=True)
              .unionByName(edge(2, -1, F.concat("key", F.unhex(F.lit("FF")))), allowMissingColumns=True))
    order = ["key", "kind", "row", "level"]
    events = stage_table(events.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "events")

    # one row per range: the number of rules active where it starts
    totals = events.groupBy("range").agg(F.sum("change").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(F.broadcast(start), "range").withColumn("depth", F.col("start") + F.sum("change").over(running))
    slot = Window.partitionBy("range", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("own", F.last("rule", ignorenulls=True).over(slot))

    # rules that were opened in an earlier range: the last of each slot, for all ranges up to the next that fills the slot
    last = stage_table(swept.filter("kind = 0").groupBy("range", "depth").agg(F.max_by("rule", "key").alias("held")), "slots")
    until = F.coalesce(F.lead("range").over(Window.partitionBy("depth").orderBy("range")),
                       F.lit(events.agg(F.max("range")).first()[0] or 0))
    held = (last.select("depth", "held", "range", until.alias("until")).filter("until > range")
            .select("depth", "held", F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range")))
    found = (swept.filter("kind = 1").select("row", "page_id", "host", "path", "range", "depth", "own", "level")
             .join(held, ["range", "depth"], "left")
             .withColumn("rule", F.when(F.col("depth") > 0, F.coalesce("own", "held"))))
    # the sizes lead the struct: its greatest is the longest rule
    return (found.groupBy("row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"),
                                     F.max("path").alias("path"), F.max("rule").alias("best"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
