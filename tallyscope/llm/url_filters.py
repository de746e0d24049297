"""URL filter by redirect equivalence.

Pages whose addresses are joined by redirects or canonical links are one resource under several names. A block rule
that fits one name reaches every alias through the connected components of those links; an explicit allow rule wins
over what is propagated, for its own address and for the aliases that no rule names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import SMALL, ascii_lower, checked, materialize
from tallyscope.llm.components import connected_components

#: Rules are compiled into one CASE expression; a list beyond this does not belong there.
MAX_RULES = 1000


class Rule(NamedTuple):
    """Blocks or allows the host and its subdomains where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(found, F.lit("")))


def url_path(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The address that links are compared by: no fragment, scheme and host lower-cased. Null without ://."""
    head = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)([^#]*)", 1)
    tail = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)([^#]*)", 2)
    return F.when(head != "", F.concat(ascii_lower(head), tail))


def resolve(base: Column, target: Column) -> Column:
    """An absolute, scheme-relative or root-relative link target as an address; others give null."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
    )


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest fitting rule (on equal length the longer host, then the first); null if
    none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))
    cases = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,action:string>")


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the canonical link and the meta refresh target of each page, as address keys."""
    html, url = F.col("html"), F.col("url")
    tag = F.regexp_extract(html, r"(?i)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    tag = F.regexp_extract(html, r"(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>", 0)
    refresh = F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = pages.select(url.alias("url"), F.explode(F.array(canonical, refresh)).alias("target")).where("target <> ''")
    return found.select(url_key(F.col("url")).alias("a"), url_key(resolve(F.col("url"), F.col("target"))).alias("b"))


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url, html).

    The verdict is that of the longest fitting rule. Without a rule it is "block" if an alias of the page (any
    address of its link component) is blocked by a rule and none is allowed by one, else `default`. `redirects`
    (from_url, to_url) adds logged redirects to the links found in html. A null url, or one without ://, has an empty
    host and path and no aliases; null html has no links; repeated rows are judged alike; an empty table gives an
    empty result. Other columns are ignored.
    """
    judged = pages.select(
        "page_id", url_key(F.col("url")).alias("key"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(
            redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b"))
        )
    links = materialize(links.where("a is not null and b is not null and a <> b").distinct(), "links")
    rule, action = F.col("hit.rule").alias("rule"), F.col("hit.action")
    stars = connected_components(links)
    members = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    ruled = members.withColumn("action", match_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["action"])
    classes = ruled.groupBy("component").agg(
        F.bool_or(F.col("action").eqNullSafe("block")).alias("blocked"),
        F.bool_or(F.col("action").eqNullSafe("allow")).alias("allowed"),
    )
    blocked = classes.where("blocked and not allowed").select("component")
    aliases = members.join(materialize(blocked, "blocked"), "component").select(F.col("node").alias("key"), F.lit("block").alias("spread"))
    # written: a join by merge then has a plain shuffle on both sides, which adaptive execution splits for a hot address
    aliases = materialize(aliases, "aliases")
    return judged.join(checked(aliases, most=SMALL // 16), "key", "left").select(
        "page_id", "host", "path", rule, F.coalesce(action, F.col("spread"), F.lit(default)).alias("verdict")
    )
