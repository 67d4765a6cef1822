"""URL rules (host, path prefix) matched by a sorted sweep over nested intervals.

A host is written in reverse and closed by a dot, so that a rule for a host and its
subdomains covers one interval of sorted keys; a path prefix covers one interval of
sorted paths. Intervals of prefixes are nested or disjoint. Sorted together, the last
rule that opened before a key carries the stack of rules open at that point, and the
rules that still fit the key are those of the stack that are prefixes of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def _with_stack(rules: DataFrame, block: list[str], key: str, payload: Column) -> DataFrame:
    """For each (block, key): the payloads of all rules of the block whose key is a prefix of it."""
    prefixes = rules.select(*block, key).distinct().withColumn(
        "_prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.col(key).substr(F.lit(1), n)))
    )
    opened = rules.select(*block, F.col(key).alias("_prefix"), payload.alias("_rule"))
    return (
        prefixes.join(opened.hint("merge"), [*block, "_prefix"])
        .groupBy(*block, key).agg(F.collect_set(F.struct(F.col("_prefix").alias("key"), F.col("_rule").alias("rule"))).alias("_stack"))
    )


def _sweep(rows: DataFrame, stacks: DataFrame, block: list[str], key: str) -> DataFrame:
    """Rows with ``_open``: payloads of the rules whose interval holds the row's key."""
    both = rows.withColumn("_is_row", F.lit(1)).unionByName(stacks.withColumn("_is_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*block).orderBy(key, "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.filter(F.col("_seen"), lambda r: F.startswith(F.col(key), r["key"]))
    return (
        both.withColumn("_seen", F.last("_stack", ignorenulls=True).over(order))
        .where("_is_row = 1")
        .withColumn("_open", F.transform(fits, lambda r: r["rule"]))
        .drop("_is_row", "_stack", "_seen")
    )


def match_rules(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int = 4000
) -> DataFrame:
    """Columns id, host, path, rule, verdict for every row.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where
    the path starts with the rule's path; the longest rule (host and path together)
    wins, then the longer host, then allow, then the larger verdict. Without a rule the rule is
    null and the verdict ``default``. Null urls and urls without :// have empty host
    and path. Rows with equal urls, null ids and empty tables are kept as they are;
    columns beside id and url are not read. A url of any length is judged whole; only its
    host and path are carried on.

    Hosts with more than one of ``parts`` of all rows are dealt to several sorted
    blocks, each with a copy of their rules; there are fewer than ``parts`` such hosts,
    which bounds the table that is broadcast.
    """
    r = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("_verdict")
    ).distinct()
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    counts = urls.groupBy("host").agg(F.count("*").alias("_n"))
    total = pages.count()

    # Which rule hosts cover a host: a sweep over distinct hosts, dealt to blocks that hold all rule hosts each.
    n_rule_hosts = r.select("rule_host").distinct().count()
    blocks = max(1, min(parts, total // max(1000, n_rule_hosts)))
    deal = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    hosts = counts.select("host", "_n", _reversed(F.col("host")).alias("_key"), F.pmod(F.xxhash64("host"), F.lit(blocks)).cast("int").alias("_block"))
    rule_hosts = r.select("rule_host", _reversed(F.col("rule_host")).alias("_key")).distinct().withColumn("_all", F.lit(0))
    host_stacks = _with_stack(rule_hosts, ["_all"], "_key", F.col("rule_host")).drop("_all").withColumn("_block", deal)
    covered = _sweep(hosts, host_stacks, ["_block"], "_key").select("host", "_n", F.explode("_open").alias("rule_host"))

    # Rules as they stand on each covered host, then a sweep over the paths of that host.
    large = total / parts
    copies = F.ceil(F.col("_n") / F.lit(max(large, 1.0))).cast("int")
    on_host = covered.join(r.hint("merge"), "rule_host").withColumn("_copies", F.when(F.col("_n") > large, copies).otherwise(1))
    best = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("_verdict").alias("verdict"),
    )
    path_stacks = (
        _with_stack(on_host.withColumnRenamed("rule_path", "_p").withColumn("rule_path", F.col("_p")), ["host", "_copies"], "_p", best)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .select("host", "_block", F.col("_p").alias("path"), "_stack")
    )
    hot = counts.where(F.col("_n") > large).select("host", copies.alias("_copies"))
    dealt = urls.join(F.broadcast(hot), "host", "left").withColumn(
        "_block", F.when(F.col("_copies") > 1, F.pmod(F.xxhash64("path", "page_id"), F.col("_copies"))).otherwise(0).cast("int")
    ).drop("_copies")
    longest = F.array_max(F.transform(F.col("_open"), lambda x: F.struct(
        x["size"].alias("size"), x["host_size"].alias("host_size"), x["rule"].alias("rule"),
        F.when(x["verdict"] == "allow", 1).otherwise(0).alias("order"), x["verdict"].alias("verdict"),
    )))
    return (
        _sweep(dealt, path_stacks, ["host", "_block"], "path").withColumn("_best", longest)
        .select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    )
