"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits it. A url that no rule fits takes the verdict of its aliases: urls are
joined by redirect and canonical-link edges into components (alternating stars); an alias that a rule allows makes the
component allowed, else one that a rule blocks makes it blocked, else it is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import components


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """``verdict, host, path, name`` of the rules, each host and path once; ``allow`` comes before ``block``."""
    rows = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    return rows.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("name", F.concat("host", "path"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, own`` of the distinct ``host, path`` of ``urls`` that a rule fits: name and verdict of the longest.

    A url meets rules by equality alone: its host's suffixes with the rules' hosts, then, for each length that a path of
    such a host's rules has, the beginning of its path with the rules' paths. So the rules may be of any number, on any
    number of hosts. Among equally long rules the first by name wins.
    """
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    ends = places.select("host", "path", F.explode(suffixes).alias("rule_host"))
    lengths = rules.select(F.col("host").alias("rule_host"), F.length("path").alias("size")).distinct()
    met = ends.join(lengths, "rule_host").filter(F.col("size") <= F.length("path"))
    met = met.withColumn("rule_path", F.expr("substring(path, 1, size)"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", F.col("name").alias("rule"))
    fits = met.join(known, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("size"), "rule", "verdict")).alias("b"))
    return best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("own"))


_FOUND = re.compile(r"<!--|<(script|style|noscript|template|textarea|title|link|meta)\b", re.I)
_BREAK = re.compile(r"[\"'>]")
_CANONICAL = re.compile(r"\brel\s*=\s*[\"']?canonical\b", re.I | re.A)
_REFRESH = re.compile(r"\bhttp-equiv\s*=\s*[\"']?refresh\b", re.I | re.A)
_HREF = re.compile(r"\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I | re.A)
_URL = re.compile(r"\burl\s*=\s*[\"']?([^\"'\s>]+)", re.I | re.A)


def page_targets(page: str) -> tuple[str | None, str | None]:
    """The targets of the first canonical link and of the first refresh redirect; comments, scripts and the like are passed over.

    One pass: a search goes on where the last one ended, and once nothing closes a comment, element or quote, nothing will.
    """
    at, canonical, refresh, quotes = 0, None, None, True
    while (canonical is None or refresh is None) and (m := _FOUND.search(page, at)):
        name = (m[1] or "").lower()
        if name not in ("link", "meta"):
            end = page.find("-->", m.end()) if not name else -1
            if name:
                close = re.compile(rf"</{name}\b", re.I).search(page, m.end())
                end = close.end() if close else -1
            if end < 0:
                break  # open to the end of the page
            at = end
            continue
        end = m.end()
        while quotes and (q := _BREAK.search(page, end)) and q[0] != ">":
            closed = page.find(q[0], q.end())
            quotes, end = closed >= 0, closed + 1 if closed >= 0 else m.end()
        end = page.find(">", end)
        if end < 0:
            break
        tag, at = page[m.end() : end], end + 1
        if name == "link" and canonical is None and _CANONICAL.search(tag):
            canonical = found[1] if (found := _HREF.search(tag)) else ""
        elif name == "meta" and refresh is None and _REFRESH.search(tag):
            refresh = found[1] if (found := _URL.search(tag)) else ""
    return canonical or None, refresh or None


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``u, v``: each page's url and the target of its canonical link or its refresh redirect, without fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, targets = [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for to in page_targets(page):
                    if to:
                        urls.append(url)
                        targets.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(targets, pa.string())], names=["from", "to"])

    asked = pages.select(F.col(url_col).alias("from"), F.col(html_col).alias("html")).filter("`from` is not null and html rlike '(?i)canonical|refresh'")
    found = asked.mapInArrow(run, "`from` string, `to` string")
    site = F.regexp_extract("from", r"^[^/?#]*://[^/?#]*", 0)
    scheme = F.regexp_extract("from", r"^[^/?#]*:", 0)
    whole = F.when(F.startswith("to", F.lit("//")), F.concat(scheme, F.col("to"))).when(F.startswith("to", F.lit("/")), F.concat(site, F.col("to"))).otherwise(F.col("to"))
    return found.select(node(F.col("from")).alias("u"), node(whole).alias("v")).filter("u != v")


def node(url: Column) -> Column:
    """A url without its fragment and with its host in lower case."""
    cut = F.regexp_extract(url, r"^[^#]*", 0)
    return F.when(_rest(cut).isNull(), cut).otherwise(F.concat(F.substring_index(cut, "://", 1), F.lit("://"), host_of(cut), F.regexp_extract(_rest(cut), r"^[^/?#]*([\s\S]*)$", 1)))


def judge(
    pages: DataFrame,
    rules: list[Rule] | DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` is a list or a table (``verdict, host, path``) of any size. ``redirects`` (``u, v`` urls) adds edges to those in the pages. A null url, or one without ``://``, has empty host
    and path, fits no rule and is allowed unless an alias says otherwise (null has none). Null html has no edges.
    Repeated rows and ids are judged row by row; other columns are not read. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    edges = page_edges(rows)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("u")).alias("u"), node(F.col("v")).alias("v")))
    joined = components(written(edges.distinct(), "links"))
    listed = rule_table(pages.sparkSession, rules)
    placed = joined.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    told = placed.join(matched(placed, listed), ["host", "path"], "left").groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    told = joined.join(told, "component").select("node", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("alias_verdict"))
    told = written(told, "aliases")
    judged = rows.select("page_id", node(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.join(told, "node", "left").join(matched(judged, listed), ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"))


#: The query's rules.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

_SQL_HOST = "translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_REST = "case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) end"
_SQL_NODE = (
    "case when instr(regexp_extract({url}, '^[^#]*'), '://') = 0 then regexp_extract({url}, '^[^#]*') else split_part({url}, '://', 1) || '://' || "
    + _SQL_HOST.format(rest=_SQL_REST)
    + " || regexp_extract(regexp_extract(" + _SQL_REST + ", '^[^#]*'), '^[^/?#]*((.|\\n)*)$', 1) end"
)
ORACLE = f"""
with recursive rules(verdict, rhost, rpath) as (values {', '.join(str((r.verdict, r.host, r.path)) for r in RULES)}),
found as (
  select url, html, regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'i'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i') as a,
    regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'i'), '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i') as b
  from pages where url is not null),
targets as (select url, unnest([a, b]) as t from found),
whole as (
  select url, case when starts_with(t, '//') then regexp_extract(url, '^[^/?#]*:') || t
    when starts_with(t, '/') then regexp_extract(url, '^[^/?#]*://[^/?#]*') || t else t end as t from targets where t != ''),
edges as (select {_SQL_NODE.format(url='url')} as u, {_SQL_NODE.format(url='t')} as v from whole),
ways as (select u, v from edges where u != v union select v, u from edges where u != v),
reach as (select u as node, u as alias from ways union select reach.node, ways.v from reach join ways on reach.alias = ways.u),
urls as (
  select alias as url from reach union select url from pages where url is not null),
parts as (select url, coalesce({_SQL_HOST.format(rest=_SQL_REST.format(url='url'))}, '') as host,
    coalesce(regexp_extract({_SQL_REST.format(url='url')}, '^[^/?#]*([^?#]*)', 1), '') as path from urls),
fits as (
  select url, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from parts left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by url, host, path),
told as (
  select reach.node, case when bool_or(verdict = 'allow') then 'allow' when bool_or(verdict = 'block') then 'block' else 'allow' end as verdict
  from reach join fits on fits.url = reach.alias group by reach.node)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(fits.verdict, told.verdict, 'allow') as verdict
from pages left join fits on fits.url = pages.url left join told on told.node = {_SQL_NODE.format(url='pages.url')}
"""
