"""URL filter: a sort-merge range join of urls with host and path rules, on DataFrame operations only.

A host is keyed by its labels in reverse order, each followed by a dot (``a.example.net`` gives
``net.example.a.``). A rule's host and all its subdomains are then one interval of keys, from
``net.example.`` up to, not including, ``net.example/``. Intervals of hosts nest or are disjoint, so
one sorted sweep over their ends with a stack of open rules cuts the key space into segments that
each carry the stack of the rules active there. Urls are merged with the segments in key order:
the last segment that starts at or before a url's key is its own. From that stack the rule with
the longest text whose path begins the url's path decides.

The sweep is cut into spans of ``SPAN`` interval ends in key order; a span starts with the stack of the intervals that were opened before it and are still open, so spans are swept side by side and the
work grows in proportion to the rules. Rules of one host are one interval. At most ``max_rules`` (100,000) rules are replicated at a time; longer lists are judged in
blocks, of which the longest fitting rule counts. The segments are replicated to ``lanes`` lanes of urls, chosen by the id's hash: a hot host, or one url that
makes a third of all rows, is spread over all lanes.

Defined results: a null url, or one without ``://``, has an empty host and path, matches no rule and gets the
default verdict. Equal rules: the later in the list counts. Of fitting rules of one length that with the longer host decides. A rule needs a host: an empty one is an error. Repeated rows are each judged. An empty table gives an empty
result. Other columns of the table are ignored, whatever their names. Rows with a null id are judged as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import load, partitions

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, MAX_RULES = 256, 100_000
RULE = "struct<host:string,path:string,action:string>"
OPEN = "struct<lo:string,host:string,rules:array<struct<path:string,action:string>>>"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def segments(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(key, stack)``: from ``key`` to the next row's key the hosts of ``stack``, outermost first, are open, each with its rules."""
    if not all(h for h, _, _ in rules):
        raise ValueError("a rule has an empty host")
    given = spark.createDataFrame(list({(h, p): (h, p, a) for h, p, a in rules}.values()), "host string, path string, action string")
    hosts = given.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "action"))).alias("rules")).withColumn("lo", host_key(F.col("host")))
    keyed = hosts.select("lo", F.concat(F.expr("substring(lo, 1, length(lo) - 1)"), F.lit("/")).alias("hi"), F.struct("lo", "host", "rules").alias("o"))
    # One row for each end, two at most for each of a bounded number of rules: these alone are numbered in one place.
    ends = keyed.select(F.col("lo").alias("key"), F.lit(1).alias("opens"), "o").union(keyed.select("hi", F.lit(0), "o"))
    numbered = ends.withColumn("n", F.row_number().over(Window.orderBy("key", "opens"))).withColumn("span", F.expr(f"n div {SPAN}"))
    life = numbered.groupBy("o.lo").agg(F.min("n").alias("from"), F.max("n").alias("to"), F.max(F.when(F.col("opens") == 1, F.col("o"))).alias("o"))
    carried = life.where(f"from div {SPAN} < to div {SPAN}").select("from", "o", F.explode(F.expr(f"sequence(from div {SPAN} + 1, to div {SPAN})")).alias("span"))
    before = carried.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("from", "o"))).alias("b")).select("span", F.transform("b", lambda x: x["o"]).alias("before"))
    spans = numbered.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("n", "key", "opens", "o"))).alias("ends")).join(before, "span", "left")
    swept = spans.select(
        F.expr(f"""
        aggregate(ends, named_struct('stack', coalesce(before, cast(array() as array<{OPEN}>)), 'out', cast(array() as array<struct<n:int,key:string,stack:array<{OPEN}>>>)),
          (acc, e) -> transform(array(if(e.opens = 1, concat(acc.stack, array(e.o)), filter(acc.stack, r -> r.lo <> e.o.lo))),
             s -> named_struct('stack', s, 'out', concat(acc.out, array(named_struct('n', e.n, 'key', e.key, 'stack', s)))))[0],
          acc -> acc.out)""").alias("out")
    )
    rows = swept.select(F.explode("out").alias("s")).select("s.n", "s.key", "s.stack")
    return rows.select("key", "stack").union(spark.createDataFrame([("",)], "key string").select("key", F.expr(f"cast(array() as array<{OPEN}>)")))


def _with_best(urls: DataFrame, rules: Sequence[tuple[str, str, str]], lanes: int) -> DataFrame:
    """Adds to ``lane, key, id, host, path`` the rule that decides, ``best``."""
    here = urls.withColumns({"is_url": F.lit(1), "stack": F.lit(None).cast(f"array<{OPEN}>")})
    cuts = segments(urls.sparkSession, rules).select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "key", F.lit(0).alias("is_url"), "stack")
    in_order = Window.partitionBy("lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    active = here.unionByName(cuts, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(in_order)).where("is_url = 1").drop("is_url")
    fitting = "flatten(transform(stack, o -> transform(filter(o.rules, r -> startswith(path, r.path)), r -> named_struct('host', o.host, 'path', r.path, 'action', r.action))))"
    longest = f"aggregate({fitting}, cast(null as {RULE}), (best, r) -> if(best is null or length(r.host) + length(r.path) >= length(best.host) + length(best.path), r, best))"
    return active.withColumn("best", F.expr(longest)).drop("stack")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_column: str = "page_id", url_column: str = "url", default: str = "allow", lanes: int | None = None, max_rules: int = MAX_RULES
) -> DataFrame:
    """One row for each page: id, host, path, rule that decided (or null) and verdict."""
    lanes = lanes or partitions(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    judged = rows.select(F.pmod(F.xxhash64("id", "path"), F.lit(lanes)).cast("int").alias("lane"), host_key(F.col("host")).alias("key"), "id", "host", "path", F.lit(None).cast(RULE).alias("so_far"))
    single = list({(h, p): (h, p, a) for h, p, a in rules}.values())
    for i in range(0, len(single), max_rules):
        judged = _with_best(judged, single[i : i + max_rules], lanes)
        judged = judged.withColumn("so_far", F.expr("if(so_far is null or struct(length(best.host) + length(best.path), length(best.host)) > struct(length(so_far.host) + length(so_far.path), length(so_far.host)), best, so_far)")).drop("best")
    return judged.select(F.col("id").alias(id_column), "host", "path", F.concat("so_far.host", "so_far.path").alias("rule"), F.coalesce("so_far.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))


SQL = r"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
r(h, p, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, host, path, h || p as rule, action, row_number() over (partition by page_id, host, path order by length(h) + length(p) desc nulls last, length(h) desc) as nth
  from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where nth = 1
"""
