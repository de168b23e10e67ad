"""URL rules with redirect equivalence, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?://)([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """Host after the first ``://`` with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page in the alias graph: the url without fragment, its host lower-cased; null without ``://``."""
    node = F.concat(F.regexp_extract(url, _PARTS, 1), host_of(url), path_of(url), F.regexp_extract(url, _PARTS, 4))
    return F.when(url.contains("://"), node)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null. Rules are a declared list, tried longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _absolute(href: Column, url: Column) -> Column:
    scheme, host = F.regexp_extract(url, _PARTS, 1), host_of(url)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (F.when(href == "", None).when(href.contains("://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), href))
            .when(href.startswith("/"), F.concat(scheme, host, href))
            .otherwise(F.concat(scheme, host, F.when(folder == "", "/").otherwise(folder), href)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): url of a page and the target of its canonical link or of its refresh redirect, as graph nodes."""
    html = F.col("html")
    canonical = F.regexp_extract(F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    targets = F.explode(F.array(_absolute(canonical, F.col("url")), _absolute(refresh, F.col("url"))))
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", targets.alias("target"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A rule that fits decides, allow and block alike. Elsewhere the url's aliases decide: all urls joined by
    canonical links, refresh redirects or rows of ``redirects`` (source_url, target_url) form one component; it is
    blocked when a member is blocked by a rule and none is allowed by one (explicit allow goes first). A url with no
    rule and no such alias is allowed. Null urls and urls without ``://`` have empty host and path, no aliases and
    are allowed. Repeated rows stay repeated; other columns are ignored.
    """
    slim = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_edges(slim)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source_url")).alias("a"), node_of(F.col("target_url")).alias("b")).where("a is not null and b is not null"))
    groups = connected_components(edges)
    own = matched(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    decided = (groups.withColumn("own", own).groupBy("component")
               .agg(F.max((F.col("own") == "block").cast("int")).alias("blocked"), F.max((F.col("own") == "allow").cast("int")).alias("allowed"))
               .where("blocked = 1 and coalesce(allowed, 0) = 0"))
    blocked = groups.join(decided.select("component"), "component", "left_semi").select(F.col("node"), F.lit(True).alias("alias_blocked"))
    parts = slim.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("match", matched(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("match.verdict"), F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return ruled.join(blocked, "node", "left").select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"))
