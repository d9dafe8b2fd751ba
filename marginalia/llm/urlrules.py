"""URL rules with redirect equivalence.

Two urls are aliases when a redirect (``<meta http-equiv=refresh>``) or a
canonical link (``<link rel=canonical>``) joins them.  Connected components over these
links are found with DataFrame joins; a block decision reaches every alias
that has no rule of its own, and an explicit allow comes first.

Everything here is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, connected_components

#: (host, path, verdict) of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: A tag with its attributes, text that only looks like markup, and a character reference.
_TAG = r"(?is)<(?:link|meta|base)\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
_PIECE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);|&|[^&]+"
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def host_of(url):
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url):
    """What follows the host up to ``?`` or ``#``; empty for null."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url, loose: bool = False):
    """The url with its host's A-Z lower-cased; null if there is no ``://``.
    ``loose``: without scheme, fragment and ``utm_`` parameters."""
    if not loose:
        rest = F.regexp_extract(url, r"://[^/?#]*(.*)", 1)
        return F.when(F.instr(url, "://") > 0, F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url), rest))
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _attribute(tag, name):
    """An attribute's value, character references decoded; empty if absent."""
    found = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])

    def decoded(p):
        code = F.when(p.rlike("^&#[0-9]"), F.regexp_extract(p, "([0-9]+)", 1).cast("int")).when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#.([0-9a-fA-F]+)", 1), 16, 10).cast("int"))
        sign = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for n, c in _NAMED.items():
            sign = F.when(p == f"&{n};", c).otherwise(sign)
        return F.coalesce(sign, p)

    return F.trim(F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_PIECE), F.lit(0)), decoded), ""))


def without_dots(path):
    """A path whose ``.`` and ``..`` segments are resolved."""
    steps = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    walked = F.aggregate(steps, F.lit(""), lambda to, s: F.when(s == ".", to).when(s == "..", F.regexp_replace(to, "/[^/]*$", "")).otherwise(F.concat(to, F.lit("/"), s)))
    return F.when(path == "", path).otherwise(F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")))


def absolute(url, target):
    """A link's target as an absolute url; null if it is another kind of
    address, like ``mailto:``."""
    base = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^/?#]*):", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    path, rest = F.regexp_extract(target, "^([^?#]*)", 1), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.concat(F.regexp_extract(target, "^([^/?#]*://[^/?#]*)", 1), without_dots(path_of(target)), F.regexp_extract(target, r"://[^?#]*(.*)$", 1)))
        .when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), F.regexp_extract(target, "^(//[^/?#]*)", 1), without_dots(F.regexp_extract(target, "^//[^/?#]*([^?#]*)", 1)), rest))
        .when(target.startswith("/"), F.concat(base, without_dots(path), rest))
        .when(target.startswith("?"), F.concat(base, path_of(url), rest))
        .when(target.startswith("#") | (target == ""), F.concat(base, path_of(url), query, rest))
        .otherwise(F.concat(base, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of all canonical links and refresh redirects.

    ``rel`` is a list of words; character references are decoded; targets are
    resolved against the page's first ``base``; comments and scripts hold no
    links.  Targets that are no urls are left out."""
    linked = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _NO_MARKUP, " "), F.lit(_TAG), F.lit(0))
    linked = linked.select("url", tags.alias("tags"))
    base = F.get(F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _attribute(t, "href")), lambda v: v != ""), F.lit(0))
    each = linked.select("url", F.coalesce(absolute(F.col("url"), base), "url").alias("base"), F.explode("tags").alias("tag"))
    rel = F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+")
    goto = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s]+)", 1)
    target = F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(rel, "canonical"), _attribute(F.col("tag"), "href")).when(
        F.col("tag").rlike("(?i)^<meta") & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"), goto
    )
    found = each.select(F.col("url").alias("from_url"), "base", target.alias("target")).where("target <> ''")
    return found.select("from_url", absolute(F.col("base"), F.col("target")).alias("to_url")).where("to_url is not null")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` with their longest fitting ``rule``
    and its ``rule_verdict``; both null if none fits.

    A host is looked up by each of its domain suffixes, so the work per url
    doesn't grow with the number of rules.  Ties between equally long rules
    with different verdicts: allow.
    """
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        places.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length(F.concat("rule_host", "rule_path")).alias("n"),
                    (F.col("rule_verdict") == "allow").alias("allow"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    "rule_verdict",
                )
            ).alias("best")
        )
    )
    return fits.select("host", "path", "best.rule", "best.rule_verdict")


def rules_frame(spark, rules=RULES) -> DataFrame:
    rows = ", ".join("('%s', '%s', '%s')" % tuple(x.replace("'", "''") for x in r) for r in rules)
    if not rows:
        return spark.sql("select '' rule_host, '' rule_path, '' rule_verdict where false")
    return spark.sql(f"select * from values {rows} as t(rule_host, rule_path, rule_verdict)")


def judge_urls(pages: DataFrame, rules: DataFrame, loose: bool = False) -> DataFrame:
    """Verdict for every page.

    ``pages``: page_id, url, html.  ``rules``: rule_host, rule_path,
    rule_verdict.  Returns page_id, host, path, rule, verdict and ``source``
    (``rule``, ``alias`` or ``default``).

    A page's own rule decides.  A page without one is blocked if its
    component has an explicitly blocked url and no explicitly allowed one;
    else it is allowed.  ``loose``: urls that differ in scheme, fragment or
    ``utm_`` parameters only are one node.  Null urls and urls without ``://`` have empty host
    and path, no rule and no alias: allow.  Rules with an empty host never
    fit.  Repeated rows are judged alike; an empty table gives an empty one;
    columns other than the three named are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rules = rules.where("rule_host <> ''")
    pages = pages.select("page_id", "url", "html")
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url"), loose).alias("key"))
    links = scratch.save(link_edges(pages).distinct())
    ends = scratch.save(
        links.select(url_key(F.col("from_url"), loose).alias("a"), url_key(F.col("to_url"), loose).alias("b")).where("a <> b").distinct()
    )
    judged = urls.join(match_rules(urls, rules), ["host", "path"], "left")
    own = F.coalesce("rule_verdict", F.lit("none"))
    if ends.limit(1).count() == 0:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.when(own == "none", "default").otherwise("rule").alias("source"))
    component = connected_components(ends, scratch)
    nodes = links.select(F.explode(F.array("from_url", "to_url")).alias("url")).select(url_key(F.col("url"), loose).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = nodes.join(match_rules(nodes, rules), ["host", "path"]).groupBy("node").agg(F.max("rule_verdict").alias("v"), F.min("rule_verdict").alias("w"))
    verdicts = (
        component.join(ruled, "node")
        .groupBy("component")
        .agg(F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("w") == "allow").alias("allowed"))
        .where("blocked and not allowed")
    )
    aliases = scratch.save(component.join(verdicts, "component").select(F.col("node").alias("key"), F.lit(True).alias("aliased")))
    out = judged.join(aliases, "key", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("aliased"), "block").otherwise("allow")).alias("verdict"),
        F.when(own != "none", "rule").when(F.col("aliased"), "alias").otherwise("default").alias("source"),
    )
