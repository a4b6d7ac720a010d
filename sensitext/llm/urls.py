"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path; a rule fits its host and all subdomains where the URL's path starts with the rule's, and
the longest fitting rule decides. URLs that no rule fits take the decision of their aliases: redirects and canonical
links join URLs to components, and a component with an explicitly allowed URL is allowed, else one with an explicitly
blocked URL is blocked, else the default holds.

URLs meet rules by equal hosts (each URL looks under its host and every parent domain, of at most as many labels as the
longest rule host has, so very long hosts cost little), so any number of rules works;
every (host, path) is judged once, and rows get the result by joins that Spark may split at hot hosts.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no alias.
Of equal rules with different verdicts, allow wins. Links with a null end are ignored. Repeated rows are judged
alike. Only the columns named are used; others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(after, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a page in links: the URL up to its fragment, null for what is no URL."""
    return F.when(F.contains(url, F.lit("://")), F.substring_index(url, "#", 1))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, rule_verdict) from (verdict, "host/path") pairs."""
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("rule_verdict")) for verdict, rule in rules]
    some = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("rule_verdict"))
    at = F.instr("rule", "/")
    return some.select(
        "rule", F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"),
        "rule_verdict",
    ).filter(at > 0)


def explicit_verdicts(places: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct (host, path) that some rule fits: the longest rule and its verdict."""
    labels = F.split("host", r"\.")
    # No rule fits under more labels than the longest rule host has.
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    parents = F.expr(f"transform(sequence(greatest(1, size(labels) - {most} + 1), size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    under = (
        places.select("host", "path").filter("host != ''").distinct()
        .withColumn("labels", labels).select("host", "path", F.explode(parents).alias("rule_host"))
    )
    fits = under.join(rules, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    best = F.max(F.struct(F.length("rule"), F.col("rule"), (F.col("rule_verdict") == ALLOW).alias("allowed")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select(
        "host", "path", F.col("b.rule").alias("rule"), F.when(F.col("b.allowed"), ALLOW).otherwise(BLOCK).alias("rule_verdict")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): from each page to its canonical link and to where it sends browsers on, as absolute addresses."""
    link = F.regexp_extract("html", r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    meta = F.regexp_extract("html", r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    to = F.array(
        F.regexp_extract(link, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(meta, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    found = pages.filter(F.contains("url", F.lit("://"))).select("url", F.explode(to).alias("to")).filter("to != ''")
    to, url = F.replace("to", F.lit("&amp;"), F.lit("&")), F.col("url")
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"(?s)[^/]*$", "")
    whole = (
        F.when(F.contains(to, F.lit("://")), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.substring_index(url, ":", 1), F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, to))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return found.select(address(url).alias("a"), address(whole).alias("b"))


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``links`` has address pairs (a, b)."""
    rows = pages.select("page_id", address(F.col("url")).alias("address"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    alias = components(links.select("a", "b"))
    members = alias.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    said = members.join(explicit_verdicts(members, rules), ["host", "path"])
    decided = said.groupBy("component").agg(F.min("rule_verdict").alias("shared"))  # allow sorts before block
    shared = alias.join(decided, "component").select(F.col("node").alias("address"), "shared")
    judged = rows.join(explicit_verdicts(rows, rules), ["host", "path"], "left").join(shared, "address", "left")
    verdict = F.coalesce("rule_verdict", "shared", F.lit(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
