"""Url rules with redirect equivalence.

A rule fits a host with all its subdomains and a path prefix; the longest that
fits decides. Pages that no rule decides take the decision of their aliases:
canonical links and redirects are edges, connected components of them are
aliases, and a component with a blocked member blocks the rest unless some
member is explicitly allowed. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table
from .components import connected_components

#: (host, path) rules and what they do; fixed values of the production query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case and path as written; both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substring(url, F.length(rest) + 4, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, both null without one.
    Of equally long rules the allowing one wins, then the first in order."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    pick = lambda value: reduce(lambda rest, x: F.when(x[1], F.lit(value(x[0]))).otherwise(rest), list(zip(ranked, fits, strict=True))[::-1], F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def with_node(df: DataFrame, url: str, out: str) -> DataFrame:
    """df with what the urls of one page have in common: scheme and host in ASCII lower
    case, a path without dot segments, the query; no fragment. Null without '://'. In
    steps of a column each, so that no part is worked out twice."""
    column = lambda name: F.col(f"_node_{name}")
    steps = [
        {"url": F.when(F.instr(F.col(url), "://") > 0, F.substring_index(F.col(url), "#", 1))},
        {"scheme": ascii_lower(F.substring_index(column("url"), "://", 1))},
        {"rest": F.substring(column("url"), F.length(column("scheme")) + 4, F.length(column("url")))},
        {"site": ascii_lower(F.regexp_extract(column("rest"), r"^[^/?]*", 0)), "path": F.regexp_extract(column("rest"), r"^[^/?]*([^?]*)", 1), "query": F.regexp_extract(column("rest"), r"(?s)\?.*", 0)},
    ]
    for step in steps:
        df = df.withColumns({f"_node_{k}": v for k, v in step.items()})
    whole = F.concat(column("scheme"), F.lit("://"), column("site"), without_dots(column("path")), column("query"))
    return df.withColumn(out, whole).drop(*(f"_node_{k}" for step in steps for k in step))


def without_dots(path: Column) -> Column:
    """An absolute path with its segments '.' and '..' resolved."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, lambda held, x: F.when(x == "..", up(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))).otherwise(path)


#: The characters that attributes name most.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def unescaped(value: Column) -> Column:
    """Numeric entities and the ENTITIES as the characters they stand for."""
    parts = F.split(value, "&#")
    code = lambda p: F.coalesce(F.conv(F.nullif(F.regexp_extract(p, "^[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(p, "^([0-9]{1,7});", 1), F.lit(""))).cast("long")
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    fine = lambda n: (n > 0) & (n < 0xD800) | (n > 0xDFFF) & (n < 0x110000)
    coded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(code(p).alias("n"), p.alias("p")))
    each = F.transform(coded, lambda x: F.when(fine(x["n"]), F.concat(letter(x["n"]), F.regexp_replace(x["p"], "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x["p"])))
    numbered = F.when(F.contains(value, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), F.array_join(each, ""))).otherwise(value)
    return reduce(lambda text, x: F.replace(text, F.lit(x[0]), F.lit(x[1])), ENTITIES, numbered)


def resolved(base: Column, to: Column) -> Column:
    """The url that a link on the page at base means; null where it is no web address
    (as mailto: or javascript:)."""
    scheme = F.substring_index(base, "://", 1)
    rest = F.substring(base, F.length(scheme) + 4, F.length(base))
    site, path = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(site, F.when(path == "", "/").otherwise(F.regexp_extract(path, "^.*/", 0)), to))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) for each page and its canonical link or its meta refresh target, as nodes;
    entities are read, and references resolved against the page's url."""
    tags = lambda name: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    canonical = F.when(F.col("html").rlike(r"(?i)\bcanonical\b"), F.transform(
        F.filter(tags("link"), lambda t: t.rlike(r"(?is)rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")), lambda t: value(t, "href")))
    refresh = F.when(F.col("html").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.transform(
        F.filter(tags("meta"), lambda t: t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh")), lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)))
    none = F.array().cast("array<string>")
    found = pages.where(F.col("url").contains("://")).select("url", F.explode(F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))).alias("to")).where("to != ''")
    found = found.withColumn("to", unescaped(F.col("to"))).withColumn("to", resolved(F.col("url"), F.col("to")))
    return _edges(found, "url", "to")


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between urls as edges (a, b) between nodes. They are written once as they
    are: filters on nodes would be pushed down to the urls, with all of a node's steps in
    each place."""
    both = with_node(with_node(links, a, "_a"), b, "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return materialize(both, "links").where("a IS NOT NULL AND b IS NOT NULL")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page (url, html).

    redirects: further (a, b) pairs of urls. A null url, or one without '://', has
    an empty host and path, fits no rule and takes the default. A null html has no
    links. Rows are judged one by one, so repeated rows and null page_ids give their own
    results; very long pages are searched whole; an empty table gives an empty result;
    other columns are ignored. Urls of one node (see `with_node`) are aliases of one another:
    they differ in the case of scheme or host, in dot segments or in the fragment. Of two
    aliases, one allowed by a rule and one blocked,
    each keeps its own rule's verdict, and the rest are allowed.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(_edges(redirects.select("a", "b"), "a", "b"))
    members = connected_components(edges)
    host, path = host_and_path(F.col("node"))
    votes = members.withColumn("vote", rule_for(host, path, rules)[1])
    blocked = votes.groupBy("component").agg(F.max(F.col("vote") == "allow").alias("allowed"), F.max(F.col("vote") == "block").alias("blocked")).where(
        "blocked and not coalesce(allowed, false)")
    aliases = members.join(blocked, "component", "left_semi").select("node").distinct().withColumn("alias_blocked", F.lit(True))
    host, path = host_and_path(F.col("url"))
    judged = with_node(pages.select("page_id", "url", host.alias("host"), path.alias("path")), "url", "node")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"rule": rule, "decided": verdict}).join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("alias_blocked"), "block"), F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
