"""URL filters by redirect equivalence.  DataFrame functions only.

A rule (action, host, path) fits the host and its subdomains where the url's
path starts with the rule's; the longest fitting rule decides (at equal length,
allow before block).  A url that no rule fits takes its decision from its
aliases: the urls reachable over redirect edges (``<meta http-equiv=refresh>``)
and canonical-link edges (``<link rel=canonical>``), as connected components
computed by Spark.  In a component with a blocked member such urls
are blocked, unless a member is explicitly allowed: an explicit allow takes
precedence over block, both for the url itself and for what is propagated.

Two urls are one node when host (A-Z lower-cased), path (without ``.`` and
``..`` segments) and query agree; scheme and fragment don't count.  Character
references in a target are decoded (numeric ones and the five of XML); a
relative target is resolved against the page's ``<base href>``, or else its url:
``//host``, ``/path``, ``path``, ``../path``, ``?query``; an empty target or a
fragment is the page itself.  Targets of other schemes (``mailto:``) make no
edge, and neither do tags within comments, scripts, styles, templates, titles or
text areas.  Targets need not be pages themselves.

Defined results: a null url or one without ``://`` has an empty host and path,
no alias, and is allowed unless a rule with an empty host fits; a null html has
no edges; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.components import components

#: Up to so many rules are written into the expression; more are joined on the host's suffixes.
INLINE_RULES = 200
#: Rules that are joined are broadcast up to this number (at most a few hundred bytes each).
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the registered query (fixed values).
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written into the plan once, however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def _plain_path(path: Column) -> Column:
    """Without ``.`` and ``..`` segments."""

    def walked(parts: Column) -> Column:
        dots = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        seen = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.concat(seen, F.array(x))),
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(seen, dots), "/"))

    return _let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _let(F.split(F.substring(p, 2, 1 << 30), "/"), walked)).otherwise(p))


def node_of(url: Column) -> Column:
    """The url's node: //host/path?query; null without a host."""

    def named(u: Column) -> Column:
        path = _let(_plain_path(path_of(u)), lambda p: F.when(p == "", "/").otherwise(p))
        return _let(host_of(u), lambda host: F.when(host != "", F.concat(F.lit("//"), host, path, _query_of(u))))

    return _let(url, named)


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path)


def _ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.action != "allow", r.name))


def judge_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls(host, path, ...)`` with ``rule`` and ``action`` of the longest fitting rule, else nulls."""
    ranked = _ordered(rules)
    if len(ranked) <= INLINE_RULES:
        name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = _fits(F.col("host"), F.col("path"), r)
            name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
        return urls.withColumn("rule", name).withColumn("action", action)
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.name, r.action, i) for i, r in enumerate(ranked)], "r_host string, r_path string, rule string, action string, rank long")
    if len(ranked) <= BROADCAST_RULES:
        table = F.broadcast(table)
    # judged once for each distinct (host, path), so that a hot host is joined once for each of its paths
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    best = places.withColumn("r_host", F.explode(suffixes)).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = best.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "action")).alias("b")).select("host", "path", "b.rule", "b.action")
    return urls.join(best, ["host", "path"], "left")


#: What holds no tags, and an attribute's value with its quotes.
_NO_TAGS = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|title|textarea)\b[^>]*+>.*?(?:</\1\b[^>]*+>|$)"
_TAG = r"(?is)<%s\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_VALUE = r"\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"
_XML = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, decoded and trimmed; empty if it has none."""
    raw = F.regexp_replace(F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}{_VALUE}", 1), r"^[\"']|[\"']$", "")
    pieces = F.regexp_extract_all(raw, F.lit(r"&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[a-z]{2,4};|[^&]+|&"), F.lit(0))

    def decoded(x: Column) -> Column:
        digits = F.when(x.rlike("^&#[xX]"), F.substring(x, 4, 6)).otherwise(F.substring(x, 3, 7))
        code = F.conv(F.regexp_replace(digits, ";", ""), 10, 16)
        code = F.when(x.rlike("^&#[xX]"), F.regexp_replace(digits, ";", "")).otherwise(code)
        out = F.when(x.rlike("^&#.+;$"), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        for ref, sign in _XML.items():
            out = out.when(x == f"&{ref};", sign)
        return out.otherwise(x)

    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, decoded), ""), r"[\x09-\x0d]", ""))


def resolve(base: Column, to: Column) -> Column:
    """The target as a whole url; null for other schemes."""

    def joined(x: Column) -> Column:
        base, to = x["base"], x["to"]
        root = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
        folder = _let(path_of(base), lambda path: F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^.*/", 0)).otherwise("/"))
        return (
            F.when(to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), to)
            .when(to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(to.startswith("//"), F.concat(F.lit("http:"), to))
            .when((to == "") | to.startswith("#"), base)
            .when(to.startswith("/"), F.concat(root, to))
            .when(to.startswith("?"), F.concat(root, path_of(base), to))
            .otherwise(F.concat(root, folder, to))
        )

    return _let(F.struct(base.alias("base"), to.alias("to")), joined)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): nodes joined by a redirect or a canonical link."""
    linking = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("url"), F.regexp_replace(F.col(html), _NO_TAGS, " ").alias("html"))
    tags = lambda name: F.regexp_extract_all("html", F.lit(_TAG % name), F.lit(0))
    canonical = F.filter(tags("link"), lambda t: (F.concat(F.lit(" "), F.lower(_attribute(t, "rel")), F.lit(" "))).rlike(r"\scanonical\s"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    after = r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$"
    targets = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(F.filter(F.transform(refresh, lambda t: _attribute(t, "content")), lambda c: c.rlike(after)), lambda c: F.trim(F.regexp_replace(F.regexp_extract(c, after, 1), r"^[\"']|[\"'].*$", ""))),
    )
    base = F.coalesce(_attribute(F.get(tags("base"), F.lit(0)), "href"), F.lit(""))
    found = linking.select("url", base.alias("base"), F.explode(targets).alias("to"))
    whole = _let(F.coalesce(resolve(F.col("url"), F.col("base")), F.col("url")), lambda base: resolve(base, F.col("to")))
    return found.select(node_of(F.col("url")).alias("u"), node_of(F.when(F.col("to") == "", F.col("url")).otherwise(whole)).alias("v")).where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """``pages``' columns but ``html``, with host, path, rule and verdict."""
    own = {c: f"c{i}" for i, c in enumerate(pages.columns) if c not in ("host", "path", "rule", "verdict", html)}
    seen = pages.select(*[F.col(c).alias(n) for c, n in own.items()], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("__node"))
    seen = judge_rules(seen, rules)
    groups = components(alias_edges(pages, url, html))
    parts = {"host": host_of(F.concat(F.lit("x:"), F.col("node"))), "path": path_of(F.concat(F.lit("x:"), F.col("node")))}
    ruled = judge_rules(groups.withColumns(parts), rules)
    decided = ruled.groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)).alias("said"))
    spread = groups.join(decided.where("said > 0"), "component").select(F.col("node").alias("__alias"), "said")
    judged = seen.join(spread, seen["__node"] == spread["__alias"], "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("said") == 1, "block").otherwise("allow"))
    return judged.select(*[F.col(n).alias(c) for c, n in own.items()], "host", "path", "rule", verdict.alias("verdict"))


_RULE_ROWS = ", ".join(f"('{r.action}', '{r.host}', '{r.path}', {i})" for i, r in enumerate(_ordered(RULES)))
#: The same rows in DuckDB for tables without redirect or canonical links.
SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(action, r_host, r_path, rank)),
best AS (
  SELECT rid, min_by(r_host || r_path, rank) AS rule, min_by(action, rank) AS action
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)
"""
