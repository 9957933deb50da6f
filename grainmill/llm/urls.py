"""URL filters with redirect equivalence.

Pages that redirect to one another, or name one another as canonical, are one page under several addresses.
Connected components over these edges carry a block to addresses that no rule names. What is explicitly
allowed stays allowed: a page by its own rule, and the other addresses of a component that has an allowed one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.shelf import Shelf, lookup


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_LINK = r"(?i)<link\b[^<>]*>"
_META = r"(?i)<meta\b[^<>]*>"
_CANONICAL = r"(?i)\srel\s*=\s*[\"']?[^\"'<>]*\bcanonical\b"
_REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh\b"
_HREF = r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TARGET = r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s<>]+)"


_BASE = r"(?i)<base\b[^<>]*>"
_DOTS = r"(?s)(^|/)\.\.?(/|$)"
#: Character references: a number, or one of NAMED.
_CODE = r"(?s)^#(?:0*([0-9]{1,7})|[xX]0*([0-9A-Fa-f]{1,6}));"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return _part(url, 2)


def address(url: Column) -> Column:
    """Host, path and query: what two spellings of one address share. Null for what is no absolute URL."""
    return F.when(url.contains("://"), F.concat(host(url), _without_dots(path(url)), _part(url, 3)))


def _without_dots(path_: Column) -> Column:
    """A path without its segments '.' and '..'."""
    parts = F.split(path_, "/", -1)
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(path_.rlike(_DOTS), F.array_join(kept, "/")).otherwise(path_)


def _decoded(text: Column) -> Column:
    """Text of an attribute, its character references replaced in one pass."""

    def read(x: Column) -> Column:
        ten, hexa = F.regexp_extract(x, _CODE, 1), F.regexp_extract(x, _CODE, 2)
        code = F.when(ten != "", ten.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code)), 8, "0")), "UTF-32")
        out = F.when(sound, F.concat(sign, F.regexp_replace(x, _CODE, "")))
        for name, sign in NAMED.items():
            out = out.when(x.startswith(name + ";"), F.concat(F.lit(sign), F.substring(x, len(name) + 2, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), x))

    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule], value) -> Column:
    """`value` of the longest rule that fits the host or a domain above it and begins the path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _absolute(target: Column, url: Column) -> Column:
    """`target` as seen from `url`."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("#") | (target == ""), url)
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of what they redirect to or name as canonical."""
    linked = pages.where("url is not null and html is not null").where(
        F.col("html").rlike(r"(?i)canonical|http-equiv")
    )
    tags = lambda tag, kind: F.filter(
        F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: x.rlike(kind)
    )
    href = lambda x: F.concat(*[F.regexp_extract(x, _HREF, i) for i in (1, 2, 3)])
    targets = F.concat(
        F.transform(tags(_LINK, _CANONICAL), href),
        F.transform(tags(_META, _REFRESH), lambda x: F.regexp_extract(x, _TARGET, 1)),
    )
    base = F.get(F.transform(tags(_BASE, _HREF), href), F.lit(0))
    # Each step passes through explode(), which keeps the optimizer from writing one step out inside the next many times.
    step = lambda rows, **cols: rows.select("url", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("x")).select("url", "x.*")
    rows = linked.select("url", base.alias("base"), F.explode(targets).alias("target"))
    rows = step(rows, base=F.trim(_decoded(F.col("base"))), target=F.trim(_decoded(F.col("target"))))
    seen_from = F.when(F.col("base").isNull(), F.col("url")).otherwise(_absolute(F.col("base"), F.col("url")))
    rows = step(rows.where("target <> ''"), target=F.col("target"), seen_from=seen_from)
    rows = step(rows, target=_absolute(F.col("target"), F.col("seen_from")))
    rows = step(rows, a=address(F.col("url")), b=address(F.col("target")))
    return rows.where("a <> b").select("a", "b").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    The longest rule that fits decides; `rules` is a list that becomes one expression per row. Where none fits:
    block if an address in the page's component is blocked by a rule and none there is allowed by one, else allow.
    Rules count for addresses that are only linked to, too. Scheme and fragment do not tell addresses apart.

    Null url, or one without "://": host and path empty, no rule, allow. Null html: no edges. Repeated rows are
    judged alike. Other columns are not read. An empty table gives an empty result.
    """
    shelf = Shelf(pages.sparkSession)
    url = F.col("url")
    named = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), address(url).alias("node"))
    edges = shelf.keep(alias_edges(pages), "links")
    parts = components(edges)
    # A node is host and path and query, so the rule of an address that is no page can be read off it.
    where = F.concat(F.lit("//"), F.col("node"))
    node_host = F.regexp_extract(where, r"(?s)^//([^/?#]*)", 1)
    node_path = F.regexp_extract(where, r"(?s)^//[^/?#]*([^?#]*)", 1)
    ruled = parts.withColumn("own", rule_of(node_host, node_path, rules, lambda r: r.verdict))
    sums = ruled.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("own") == "block").alias("bad"), F.max(F.col("own") == "allow").alias("good")
    )
    sums = shelf.keep(sums.where("bad and not coalesce(good, false)").select("component", "n"), "bad")
    blocked = lookup(parts, sums, ["component"], "n").select("node")
    named = shelf.keep(named, "named")
    held = named.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    blocked = shelf.keep(blocked.join(held, "node").withColumn("by", F.lit("block")), "blocked")
    judged = lookup(named, blocked, ["node"], "n", "left")
    at = F.col("host"), F.col("path"), rules
    return judged.select(
        "page_id",
        "host",
        "path",
        rule_of(*at, lambda r: r.name).alias("rule"),
        F.coalesce(rule_of(*at, lambda r: r.verdict), "by", F.lit("allow")).alias("verdict"),
    )
