"""URL filter rules, carried over redirects and canonical links.

Pages that redirect to each other, or name each other as canonical, are one resource under several addresses. Their
connected components are found over the edges in the pages, and a block of any address holds for all of them, but
for those that a rule decides by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(verdict, host, path)."""
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def matching_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those of ``places`` (host, path; each once) that a rule fits: the longest one, of
    equally long ones an allowing one.

    Places are joined to the rules by every suffix of their host, so a place costs its number of labels and the rules of
    its own hosts, however many rules there are.
    """
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(suffixes).alias("suffix"))
    known = rules.where("verdict in ('allow', 'block') and host is not null and path is not null").select(F.col("host").alias("suffix"), F.col("path").alias("from"), "verdict").distinct()
    fitting = asked.join(known, "suffix").where(F.startswith(F.col("path"), F.col("from")))
    text = F.concat("suffix", "from")
    best = F.max(F.struct(F.length(text).alias("size"), (F.col("verdict") == "allow").alias("allows"), text.alias("rule"), "verdict"))
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def address(url: Column) -> Column:
    """What makes two spellings one node: host, path (at least /) and query, without scheme and fragment."""
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit("")))


#: An attribute's value: in double quotes, in single ones, or bare.
VALUE = r"""\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
#: A rel attribute with canonical as one of its words.
CANONICAL = r"""(?i)\srel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|'([^']*\s)?canonical(\s[^']*)?'|canonical[\s>/])"""
REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh["'\s>/]"""
REFRESH_URL = r"""(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"']+)"""
#: Named and numbered characters that addresses are written with; the ampersand last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\s{name}{VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (2, 3, 4)])


def _decoded(value: Column) -> Column:
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _first(tags: str, wanted: str) -> Column:
    """The first tag of a kind that a pattern wants, without what stands in comments."""
    seen = F.regexp_replace("html", r"(?s)<!--.*?(-->|\z)", " ")
    return F.try_element_at(F.filter(F.regexp_extract_all(seen, F.lit(rf"(?i)<{tags}\s[^>]*>"), F.lit(0)), lambda t: t.rlike(wanted)), F.lit(1))


def _flat(path: Column) -> Column:
    """A path without its . and .. segments."""
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        none,
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))).otherwise(path)


def links_of(pages: DataFrame) -> DataFrame:
    """(url, target) of each page's first canonical link and its first meta refresh.

    Comments are skipped, rel is read as words, entities are decoded. Targets are made absolute against the page's
    address, . and .. taken out; ones of another kind than scheme:// (mailto and the like) are dropped.
    """
    canonical = _decoded(_attribute(_first("link", CANONICAL), "href"))
    refresh = _decoded(F.regexp_extract(_attribute(_first("meta", REFRESH), "content"), REFRESH_URL, 1))
    raw = pages.where("url like '%://%'").select("url", F.explode(F.array_distinct(F.array(canonical, refresh))).alias("href")).where("href <> ''")
    url, href = F.col("url"), F.col("href")
    path = path_of(url)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    site = F.concat(F.lit("http://"), host_of(url))
    target = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when(F.startswith(href, F.lit("?")), F.concat(site, F.when(path == "", "/").otherwise(path), href))
        .when(F.startswith(href, F.lit("#")), url)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )
    found = raw.select("url", target.alias("target")).where("target is not null")
    begin = F.regexp_extract("target", r"^([^:]*://[^/?#]*)", 1)
    rest = F.regexp_extract("target", r"(?s)^[^?#]*([?#].*)", 1)
    return found.select("url", F.concat(begin, _flat(path_of(F.col("target"))), rest).alias("target"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html).

    ``rules`` is a list or a table (verdict, host, path). The longest fitting rule decides a page, whatever its aliases.
    A page without one is blocked where any address in its component, pages and link targets alike, is blocked by a rule,
    and allowed otherwise. A null url, or one without ://, has an empty host and path and no aliases; null html has no
    links; repeated rows get the same verdict. Other columns are not read. A hub of links is never gathered: see
    connected_components.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = cut(links_of(narrow), "url-links")
    url, target = F.col("url"), F.col("target")
    edges = links.select(F.md5(address(url)).alias("a"), F.md5(address(target)).alias("b"))
    ends = links.select(url).union(links.select(target)).distinct().select(host_of(url).alias("host"), path_of(url).alias("path"), F.md5(address(url)).alias("node"))
    judged = matching_rules(ends.select("host", "path").distinct(), rules).where("verdict = 'block'")
    blocked = ends.join(judged.select("host", "path"), ["host", "path"]).select("node").distinct()
    parts = connected_components(edges)
    bad = parts.join(blocked, "node").select("component").distinct()
    aliases = cut(parts.join(bad, "component").select("node"), "url-blocked")
    ruled = narrow.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.md5(address(url)).alias("node"), url.contains("://").alias("whole"))
    # Written, so that the join can be split where a place is that of very many pages.
    found = cut(matching_rules(ruled.select("host", "path").distinct(), rules), "url-ruled")
    joined = ruled.join(found, ["host", "path"], "left").join(aliases.withColumn("tainted", F.lit(True)), "node", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("tainted") & F.col("whole"), "block"), F.lit("allow")).alias("verdict"))
