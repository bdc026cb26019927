"""URL filters by a sort-merge range join (DataFrame operations only).

A rule (host, path) fits a url when the rule's host is the url's host or one of its parent domains and the url's
path starts with the rule's path. Hosts are turned round label by label (``a.example.net`` -> ``net.example.a``), and
the canonical key ``reversed host + path`` makes each rule an interval: every key that starts with the rule's key,
closed by the byte 0xFF, which no UTF-8 text holds. A url becomes one point for each parent domain that has rules.
Rules open and close in the sorted order of keys. A window walks that order: opening a rule pushes it, closing it pops
back to the rule around it, so the last event before a point names the innermost active rule, the longest for that
domain. Of several domains the longest rule (host and path together, then host) wins.

Points are distinct (host, path) pairs, so repeated urls are resolved once. A domain with many points is dealt over
salts of about ``max(SWEEP_ROWS, rules of that domain)`` points, each with its own copy of the domain's events: no
task gets a whole hot domain, and copied events never outnumber the points.

Defined results: a url that is null or has no ``://`` has empty host and path; an empty host fits no rule; of rules
with equal host and path, ``block`` wins; rules with a null or empty host, a null path or a null action are ignored; no
fitting rule gives a null rule and ``default``. Every page row is returned, repeated ones and null ids too; columns
other than page_id and url are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower

SWEEP_ROWS = 256
RULE_SCHEMA = "host string, path string, action string"


def url_host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.", -1)))


def _events(rules: DataFrame) -> DataFrame:
    """Opening and closing events of the rules, in key order a stack: closing names the rule around, or none."""
    lengths = rules.select(F.col("rhost").alias("l_host"), F.length("path").alias("l_len")).distinct()
    outer = rules.select(F.col("rhost").alias("o_host"), F.col("path").alias("o_path"), F.col("rule").alias("o_rule"))
    around = (
        rules.join(lengths, (F.col("rhost") == F.col("l_host")) & (F.col("l_len") < F.length("path")))
        .withColumn("o_key", F.expr("substring(path, 1, l_len)"))
        .join(outer, (F.col("rhost") == F.col("o_host")) & (F.col("o_key") == F.col("o_path")))
        .groupBy("rhost", "path").agg(F.max(F.struct("l_len", "o_rule")).alias("m"))
        .select(F.col("rhost").alias("a_host"), F.col("path").alias("a_path"), F.col("m.o_rule").alias("parent"))
    )
    nested = rules.join(around, (F.col("rhost") == F.col("a_host")) & (F.col("path") == F.col("a_path")), "left")
    key = F.concat(F.col("rhost"), F.col("path")).cast("binary")
    opening = F.struct(key.alias("key"), F.lit(0).alias("kind"), F.struct(F.col("rule").alias("rule")).alias("state"))
    closing = F.struct(F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.struct(F.col("parent").alias("rule")).alias("state"))
    return nested.select("rhost", F.explode(F.array(opening, closing)).alias("e")).select("rhost", "e.*")


def longest_rules(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """``targets`` (host, path) without repeats -> host, path, rule struct of those that some rule fits."""
    rules = (
        rules.where("host is not null and host <> '' and path is not null and action is not null")
        .groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("action").alias("action"))
        .select(reversed_host(F.col("host")).alias("rhost"), "path",
                F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"),
                         F.concat("host", "path").alias("rule"), "action").alias("rule"))
    )
    deepest = rules.select(F.max(F.size(F.split("rhost", r"\."))).alias("d")).first()["d"] or 0
    points = (
        targets.where("host <> ''")
        .withColumn("labels", F.reverse(F.split("host", r"\.", -1)))
        .withColumn("rhost", F.explode(F.expr(
            f"transform(sequence(1, greatest(1, least({deepest}, size(labels)))), i -> concat_ws('.', slice(labels, 1, i)))")))
        .select("rhost", "host", "path")
    )
    domains = rules.groupBy("rhost").agg(F.count("*").alias("n_rules"))
    points = points.join(domains, "rhost")
    salts = (
        points.groupBy("rhost").agg(F.count("*").alias("n_points"), F.max("n_rules").alias("n_rules"))
        .select("rhost", F.ceil(F.col("n_points") / F.greatest(F.lit(SWEEP_ROWS), F.col("n_rules"))).cast("int").alias("n_salts"))
    )
    dealt = (
        points.drop("n_rules").join(salts, "rhost")
        .select("rhost", F.pmod(F.xxhash64("host", "path"), F.col("n_salts")).cast("int").alias("salt"),
                F.concat("rhost", "path").cast("binary").alias("key"), F.lit(1).alias("kind"),
                F.lit(None).cast("struct<rule:struct<len:int,host_len:int,rule:string,action:string>>").alias("state"),
                "host", "path")
    )
    copied = (
        _events(rules).join(salts, "rhost")
        .select("rhost", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), "key", "kind", "state",
                F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    )
    order = Window.partitionBy("rhost", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # rows lie by rhost already, which would do for the window: only an exchange by both columns spreads a hot domain
    events = dealt.unionByName(copied).repartition("rhost", "salt")
    swept = events.withColumn("state", F.last("state", ignorenulls=True).over(order))
    return (
        swept.where("kind = 1 and state.rule is not null")
        .groupBy("host", "path").agg(F.max("state.rule").alias("best"))
    )


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    host, path = url_host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = longest_rules(urls.select("host", "path").distinct(), rules).withColumnsRenamed({"host": "b_host", "path": "b_path"})
    return (
        urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
    )
