"""URL filter with redirect equivalence.

Rules (host and path prefix, allow or block) decide urls directly; the longest
fitting rule wins.  Urls that redirect to each other or name a canonical form are
aliases: connected components over those edges carry decisions from the urls that
rules decide to those that none does.  Edges are

* each url and its own canonical form (scheme, leading ``www.``, fragment, tracking
  parameters and trailing slash removed),
* canonical links and meta refreshes in the page, and
* rows of an optional redirect table.

Precedence: a url's own rule; else allow, if an alias is explicitly allowed; else
block, if an alias is blocked; else allow.

Defined results: a null url or one without ``://`` has an empty host and path, no
alias, no rule, and is allowed; very long pages are searched whole; repeated rows
get equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.store import Workspace

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path prefix; null if none does."""
    out = F.lit(None).cast("string")
    for _, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        out = F.when(fits, F.lit(at + prefix)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, at, prefix in rules:
        out = F.when(rule == at + prefix, verdict).otherwise(out)
    return out


def canonical_form(url: Column) -> Column:
    """The form that spellings of one address share; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, "$1"), "[?&]+$", "")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("http://"), host, path, F.lit("/"), query))


def _resolved(base: Column, link: Column) -> Column:
    """A link as an absolute url (links of other kinds are relative to the folder)."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )


#: Entities that stand for marks of urls in attributes; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def _unescaped(link: Column) -> Column:
    for entity, mark in ENTITIES:
        link = F.replace(link, F.lit(entity), F.lit(mark))
    return link


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and meta refreshes in the pages."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    tag = pages.filter("instr(url, '://') > 0").select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = tag.withColumn("link", _unescaped(F.coalesce(canonical, refresh))).filter("link <> ''")
    return found.select("url", _resolved(F.col("url"), F.col("link")).alias("target"))


def url_verdicts(pages: DataFrame, work: Workspace, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``pages`` has page_id, url and html; ``redirects`` (optional) has url and target.
    """
    judged = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    links = work.keep(links.filter("url IS NOT NULL AND target IS NOT NULL"), "links")
    ends = links.select("url").unionByName(links.select(F.col("target").alias("url")))
    urls = work.keep(pages.select("url").unionByName(ends).filter("instr(url, '://') > 0").distinct(), "urls")
    own = urls.select("url", canonical_form(F.col("url")).alias("target"))
    component = connected_components(links.unionByName(own), work)

    nodes = work.keep(urls.unionByName(own.select(F.col("target").alias("url"))).distinct(), "nodes")
    verdict = rule_verdict(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules), rules)
    member = nodes.join(component.withColumnRenamed("node", "url"), "url", "left").withColumn("component", F.coalesce("component", "url"))
    member = work.keep(member.withColumn("direct", verdict), "members")
    # an allow outranks a block, and both come from pre-aggregated minima
    decided = work.keep(member.filter("direct IS NOT NULL").groupBy("component").agg(F.min("direct").alias("passed")), "decided")
    passed = work.keep(member.filter("direct IS NULL").join(decided, "component").select("url", "passed"), "passed")
    out = judged.join(passed, "url", "left")
    final = F.coalesce(rule_verdict(F.col("rule"), rules), F.col("passed"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))
