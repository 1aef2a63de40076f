"""URL rules whose decisions follow redirects.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest fitting rule decides. Pages that no rule fits take
the decision of their aliases: pages joined by redirect and canonical-link edges
form connected components, and one explicit allow in a component outweighs any
block. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.components import components
from turnstile.llm.stored import stored

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Query parameters that do not choose a page.
TRACKING = r"(?:utm_[a-z]+|ref|source|fbclid|gclid)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


def ascii_lower(text: Column) -> Column:
    return F.translate(text, CAPITALS, CAPITALS.lower())


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the variants of an address that lead to the same page; null without ``://``.

    Scheme https; host without a leading ``www.`` or ``m.``; path without a final
    slash or ``.html``; no fragment and no tracking parameters.
    """
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)$", "")
    form = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, form)


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are worked off; ``..`` at the root is dropped."""
    empty = F.array().cast("array<string>")
    walk = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1)))))
        .when(part == ".", acc)
        .otherwise(F.array_append(acc, part)),
    )
    ends = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(walk, "/"), ends)


def resolve(href: Column, base: Column) -> Column:
    """The absolute address of a link on a page: absolute, ``//host/..``, ``/path``, ``?query`` and relative links.

    ``base`` is an address with ``://``. ``&amp;`` in the link stands for ``&``. Null for links of other kinds
    (``mailto:``), for an empty link and one that is a fragment only, and where ``base`` is no address.
    """
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(base, "^([^/?#]*://[^/?#]*)", 1)
    path, own = F.regexp_extract(href, "^([^?#]*)", 1), path_of(base)
    tail = F.substring(href, F.length(path) + 1, F.length(href))
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, "^(.*/)", 1))
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | href.rlike("^#") | (href == ""), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:/?#]*:)//", 1), href))
        .when(href.startswith("?"), F.concat(site, own, href))
        .when(href.startswith("/"), F.concat(site, without_dots(path), tail))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), tail))
    )
    return F.when(site != "", absolute)


_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*>"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def alias_edges(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(src, dst): each address to its canonical form, its canonical links and the targets of its refreshes.

    Every such tag of a page counts. Links are resolved against the page's ``base``
    tag, if it has one, else against its address. Null texts and addresses give none.
    """
    targets = F.array(canonical(F.col(url)))
    if html is not None:
        text = F.coalesce(F.col(html), F.lit(""))
        given = resolve(F.nullif(F.regexp_extract(text, _BASE, 1), F.lit("")), F.col(url))
        base = F.coalesce(given, F.col(url))
        tagged = lambda tag, link: F.transform(
            F.regexp_extract_all(text, F.lit(tag), F.lit(0)), lambda x: F.nullif(F.regexp_extract(x, link, 1), F.lit(""))
        )
        links = F.array_compact(F.concat(tagged(_CANONICAL, _HREF), tagged(_REFRESH, _TARGET)))
        targets = F.concat(targets, F.transform(links, lambda x: canonical(resolve(x, base))))
    return (
        pages.filter(F.col(url).isNotNull())
        .select(F.col(url).alias("src"), F.explode(F.array_compact(targets)).alias("dst"))
        .distinct()
    )


def rule_table(spark, rules: Sequence[UrlRule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.verdict, r.host, r.path) for r in rules], "rule_verdict string, rule_host string, rule_path string"
    )


def rule_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct address; rule and verdict are null where none fits.

    An address meets the rules of its host and of each parent domain by equality of
    host and path prefix: a host's rules first tell which lengths of path occur, so
    an address gives one row per such length and never meets the other rules of its
    host. Of equally long rules an allow wins. Rules with a null part fit nothing.
    """
    rules = rules.dropna(subset=["rule_host", "rule_path", "rule_verdict"])
    hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    known = urls.select(F.col(url).alias("url")).distinct()
    known = known.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    met = known.select("url", "path", F.explode(parents).alias("rule_host")).join(hosts, "rule_host")
    met = met.withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))))
    met = met.select("url", "rule_host", F.substring("path", F.lit(1), F.col("size")).alias("rule_path"))
    fitting = met.join(rules, ["rule_host", "rule_path"]).groupBy("url").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                (F.col("rule_verdict") == "allow").alias("allows"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return known.join(fitting, "url", "left").select("url", "host", "path", "best.rule", "best.verdict")


def url_filter(
    pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url", default: str = "allow"
) -> DataFrame:
    """(url, host, path, rule, verdict, aliased) for each distinct address.

    ``edges`` (src, dst) are redirects and canonical links; their ends need not be
    pages. A component with an address that a rule allows passes ``allow`` on to
    its addresses without a rule, else ``block`` if a rule blocks one; ``aliased``
    marks these. What is left is ``default``. A null address gets empty host and
    path, no rule and the default. Empty tables give no rows.
    """
    edges = stored(alias_edges(pages, url, None) if edges is None else edges.select("src", "dst"), "aliases")
    keyed = edges.select(F.md5("src").alias("a"), F.md5("dst").alias("b"), "src", "dst")
    groups = components(keyed, "a", "b")
    ends = pages.select(F.col(url).alias("url")).unionByName(edges.select(F.col("src").alias("url")))
    ends = ends.unionByName(edges.select(F.col("dst").alias("url")))
    judged = rule_verdicts(ends, rules).withColumn("node", F.md5("url")).join(groups, "node", "left")
    spread = (
        judged.filter("component is not null and verdict is not null")
        .groupBy("component")
        .agg(F.min("verdict").alias("alias_verdict"))
    )
    known = pages.select(F.col(url).alias("page_url")).distinct()
    judged = judged.join(spread, "component", "left")
    return known.join(judged, F.col("page_url").eqNullSafe(F.col("url")), "left").select(
        F.col("page_url").alias("url"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", "alias_verdict", F.lit(default)).alias("verdict"),
        (F.col("verdict").isNull() & F.col("alias_verdict").isNotNull()).alias("aliased"),
    )


def judge_pages(
    pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """The verdict of every row of ``pages``; repeated rows give repeated results.

    ``redirects`` (src, dst) are known redirects beside those that the pages name.
    """
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        known = redirects.select("src", "dst").dropna()
        edges = edges.unionByName(known).unionByName(alias_edges(known, "src", None)).unionByName(alias_edges(known, "dst", None))
    verdicts = url_filter(pages, rules, edges, url)
    asked = pages.select(F.col(id), F.col(url).alias("asked"))
    return asked.join(verdicts, F.col("asked").eqNullSafe(F.col("url")), "left").select(
        id, "host", "path", "rule", "verdict", "aliased"
    )
