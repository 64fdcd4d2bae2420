"""URL filters: block and allow rules, spread over redirect and canonical-link edges.

DataFrame functions only. A rule fits its host and all subdomains when the url's
path starts with the rule's; the longest fitting rule decides (equal lengths:
allow). A url without a rule takes the decision of its aliases: urls joined by
redirects or canonical links, directly or over others, form a component; an
explicit allow anywhere in it wins over an explicit block; with neither it is
allowed. A rule's own verdict is never overturned by aliases.

Defined results: null urls and urls without ``://`` have empty host and path, no
rule, no aliases, and are allowed; rows that repeat an id each give a row; other
columns of the input are not read. Rules are a parameter and make one
expression, so there may be up to 1,000 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import stash, table
from stocktake.llm.components import connected_components

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_RULES = 1000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """What names a page: host, path and query; scheme and fragment are left out. Null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url)), query))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(size, allow, rule)`` of the longest fitting rule, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(kind == "allow").alias("allow"), F.lit(h + p).alias("rule")))
        for kind, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as written in the page."""
    tag = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"), F.lit(0))
    canonical = F.transform(tag, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    meta = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"), F.lit(0))
    refresh = F.transform(meta, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    return F.when(F.coalesce(html.rlike(r"(?i)canonical|refresh"), F.lit(False)), F.array_union(canonical, refresh)).otherwise(F.array().cast("array<string>"))


def absolute(target: Column, url: Column) -> Column:
    """``target`` as seen from ``url``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.substring_index(scheme, "//", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(u, v)`` between page names, from the pages themselves and from ``redirects(src, dst)``, if any."""
    links = pages.where("url is not null and html is not null").select("url", F.explode(link_targets(F.col("html"))).alias("target")).where("target != ''")
    edges = links.select(url_node(F.col("url")).alias("u"), url_node(absolute(F.col("target"), F.col("url"))).alias("v"))
    if redirects is not None:
        edges = edges.union(redirects.select(url_node(F.col("src")).alias("u"), url_node(F.col("dst")).alias("v")))
    return edges.where("u is not null and v is not null and u != v").distinct()


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` for every row of ``pages(page_id, url, html)``."""
    url = F.col("url")
    judged = pages.select("page_id", url_node(url).alias("node"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    component = connected_components(alias_edges(pages.select("url", "html"), redirects))
    # explicit decisions of a component, summed over distinct pages before they are shuffled
    targets = component.select("node", "component", F.split_part("node", F.lit("/"), F.lit(1)).alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    known = targets.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    decided = known.groupBy("component").agg(F.max(F.col("hit.allow")).alias("any_allow"), F.min(F.col("hit.allow")).alias("all_allow"))
    alias = stash(component.join(decided, "component").select("node", "component", (~F.col("any_allow")).alias("blocked")), "aliases")
    out = judged.join(alias, "node", "left")
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.allow"), "allow").otherwise("block")).when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(kind, rhost, rpath)),
m AS (
  SELECT p.page_id, p.host, p.path, r.kind, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM m WHERE k = 1
"""
