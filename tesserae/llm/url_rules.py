"""Operator 3: URL filtering by a sort-merge range join. DataFrame functions only.

A rule (host, path prefix) covers the host, its subdomains and the paths that begin with the prefix. Its
canonical key is the reversed host and the path as bytes, which makes it an interval of sorted keys:
from the key itself up to the key and a byte that no UTF-8 text holds. Intervals of one host nest or are
apart. A url becomes one point for each of its host's suffixes that has rules. Rule starts, rule ends and
points are sorted together; a start puts its rule on top of the stack, an end gives back the enclosing
rule, and a point reads the top, that is its innermost rule.

Scale: urls are reduced to distinct (id, host, path) first; a host has as many suffixes looked up as the rules'
longest host has labels, however many it has itself; hosts without rules drop out in the join with the rules'
hosts; the sweep of a host that many urls share is dealt into slices, each with a copy of that host's rule
events, so a slice's cost is its points and the host's rules. Rules are broadcast only up to BROADCAST_RULES.

Defined cases: a null url or one without `://` has empty host and path; repeated rows come out as often as
they came in; very long urls and hosts of very many labels are read whole; null ids stay; an empty table of urls
or of rules works; other columns (of any name) are not read; of two rules alike but for the verdict, block holds;
among rules of equal length that of the longer host wins; no rule: `default` and a null rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, table

#: Up to so many rules (a few MB) the table of their hosts is broadcast; beyond it the join shuffles.
BROADCAST_RULES = 20_000
#: Points of one host that one sweep holds on average; more where the host has more rules than that in events.
SWEEP_POINTS = 2_000

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, 'host/path prefix') pairs as rows of host, path, rule, verdict."""
    rows = [(r[: r.index("/")].lower(), r[r.index("/") :], r, v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def url_parts(url):
    """(host, path) as the contract defines them; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def match_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows of (id, host, path, rule, verdict): the longest rule that covers each url."""
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("id", host.alias("host"), path.alias("path"))
    urls = urls.groupBy("id", "host", "path").agg(F.count("*").alias("copies"))

    rules = rules.groupBy("host", "path").agg(F.max_by("rule", "verdict").alias("rule"), F.max("verdict").alias("verdict"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    # the rule that encloses a rule: the longest shorter prefix of its path among the host's rules
    inner = rules.select("host", "path", "rule", "verdict", F.explode(F.expr("sequence(0, greatest(char_length(path) - 1, 0))")).alias("n"))
    inner = inner.where("n < char_length(path)").withColumn("outer", F.expr("substring(path, 1, n)"))
    outer = rules.select("host", F.col("path").alias("outer"), F.struct(F.length("path").alias("len"), "rule", "verdict").alias("parent"))
    parents = inner.join(outer, ["host", "outer"]).groupBy("host", "path").agg(F.max("parent").alias("parent"))
    nested = rules.join(parents, ["host", "path"], "left")

    # points: one for each host suffix; only those whose host has rules go to the sweep
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()[0] or 0
    labels = urls.withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.expr(f"sequence(1, least(size(labels), {max(1, deepest)}))"), lambda i: F.concat_ws(".", F.slice("labels", -i, i)))
    points = labels.select("id", "host", "path", "copies", F.explode(suffixes).alias("at"))
    counts = rules.groupBy("host").agg(F.count("*").alias("rules")).withColumnRenamed("host", "at")
    points = points.join(F.broadcast(counts) if few else counts, "at")
    sizes = points.groupBy("at", "rules").agg(F.count("*").alias("n")).select("at", F.ceil(F.col("n") / F.greatest(F.lit(SWEEP_POINTS), 8 * F.col("rules"))).cast("long").alias("slices"))
    points = points.drop("rules")
    point_slices = points.join(F.broadcast(sizes) if few else sizes, "at").withColumn("slice", F.pmod(F.xxhash64("id", "host", "path"), F.col("slices")))

    top = F.struct(F.length("path").alias("len"), "rule", "verdict")
    key = F.concat(F.encode(F.concat_ws(".", F.reverse(F.split("at", r"\."))), "UTF-8"), F.encode("path", "UTF-8"))
    events = nested.withColumnRenamed("host", "at").join(sizes, "at").withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
    starts = events.select("at", "slice", key.alias("key"), F.lit(0).alias("kind"), top.alias("top"))
    ends = events.select("at", "slice", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.coalesce("parent", F.struct(F.lit(-1).alias("len"), F.lit("").alias("rule"), F.lit("").alias("verdict"))).alias("top"))
    asked = point_slices.select("at", "slice", key.alias("key"), F.lit(1).alias("kind"), F.struct("id", "host", "path", "copies").alias("point"))
    sweep = Window.partitionBy("at", "slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(ends).unionByName(asked, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep))
    hits = swept.where("kind = 1 and top.len >= 0").select("point.*", F.struct((F.length("at") + F.col("top.len")).alias("len"), F.length("at").alias("host_len"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")).alias("hit"))

    every = urls.select("*", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit")).unionByName(hits)
    best = every.groupBy("id", "host", "path").agg(F.max("hit").alias("hit"), F.first("copies").alias("copies"))
    best = best.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP3_SQL = r"""
with rules(verdict, rule, host, path) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
parts as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
urls as (select page_id, row_number() over () as n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from parts)
select u.page_id, u.host, u.path, max_by(r.rule, length(r.rule)) as rule, coalesce(max_by(r.verdict, length(r.rule)), 'allow') as verdict
from urls u left join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
group by u.n, u.page_id, u.host, u.path
"""
