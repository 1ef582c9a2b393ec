"""URL filters: rules by host and path, and block decisions that reach aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from ._graph import components

#: (verdict, host, path) as an operator of a crawl would state them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case; empty for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null without one.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of rules as long as each other allow comes first.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _without_dots(path: Column) -> Column:
    """Path without its . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.array_join(F.concat(kept, ends), "/")).otherwise(path)


def address(url: Column) -> Column:
    """What is one and the same page: host, path (/ where it is empty, without dot segments) and query. Null without a host."""
    path = _without_dots(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query)))


def _value(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag, with or without quotes; empty without it."""
    rule = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.trim(F.concat(*(F.regexp_extract(tag, rule, i) for i in (1, 2, 3))))


def links(pages: DataFrame) -> DataFrame:
    """Edges a, b between addresses from canonical links and redirects in the html: all of a page's link tags of which canonical is a word of rel, and all its refresh tags.

    Absolute, //host, /path, ?query and relative targets are resolved against the page's url; fragments alone and other schemes give no edge.
    """
    target = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'>\s]+)"
    found = pages.where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://"))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = found.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("a"), F.explode(tags).alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & _value(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = tag.rlike("(?i)^<meta") & _value(tag, "http-equiv").rlike("(?i)^refresh$")
    to = F.when(canonical, _value(tag, "href")).when(refresh, F.regexp_extract(tag, target, 1))
    found = found.select("host", "path", "a", F.replace(F.trim(to), F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    folder = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    to = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(F.lit("x://"), "host", "to"))
        .when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.col("to").startswith("#"), F.lit(None))
        .when(F.col("to").startswith("?"), F.concat(F.lit("x://"), "host", "path", "to"))
        .otherwise(F.concat(F.lit("x://"), F.col("host"), folder, F.col("to")))
    )
    return found.select("a", address(to).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by (rule, alias or default) of each row of pages.

    Redirect equivalence: addresses joined by redirects or canonical links (those in html, and those in
    `redirects` with columns a, b of urls) form components. An address takes the verdict of its own
    rule; without one it is blocked if a rule blocks an address of its component and no rule
    allows any, as an explicit allow comes first; else it is allowed.

    Two urls that differ in scheme or fragment only are one address; those that differ in their queries are two. Null urls
    and urls without :// have empty host and path, no rule, and are allowed. Repeated rows give repeated rows;
    null html gives no edges; an empty table gives an empty result. Columns other than page_id, url and html are not read.
    """
    pages = pages.select("page_id", "url", "html")
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    found = components(edges)
    host = F.substring_index("node", "/", 1)
    path = F.substring_index(F.expr("substring(node, length(substring_index(node, '/', 1)) + 1)"), "?", 1)
    found = found.withColumn("verdict", rule_for(host, path, rules)["verdict"])
    decided = found.groupBy("component").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed")
    )
    aliases = found.select("node", "component").join(
        decided.where("blocked and not coalesce(allowed, false)").select("component"), "component"
    )
    aliases = materialize(aliases.select("node", F.lit(True).alias("reached")))
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address")
    ).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.join(aliases, F.col("address") == aliases["node"], "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("reached"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), F.lit("rule"))
        .when(F.col("reached"), F.lit("alias"))
        .otherwise(F.lit("default"))
        .alias("decided_by"),
    )
