"""URL filter with redirect equivalence, in DataFrame operations only.

A url's own decision is that of the longest rule that fits its host (subdomains included) and starts its path.
Redirects and canonical links make urls aliases: connected components over those edges carry a block to every alias
in the component. An explicit allow takes precedence twice: a url that an allow rule fits stays allowed, and a
component that holds an explicitly allowed url isn't blocked through its aliases. All else is allowed.

Edge cases: a null url or one without ``://`` has empty host and path, and is allowed; fragments don't tell urls
apart; relative targets of links are resolved against their page's url (a ``base`` element isn't read); an edge to itself or with a null end is ignored; repeated rows are judged one by one; without edges, no url
has aliases; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.graph import connected_components

MAX_RULES = 10_000
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What tells urls apart: all but the fragment."""
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(verdict, rule); null if none fits. The rules are a literal of bounded size."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can stand in a plan")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    found = None
    for verdict, rule in reversed(ordered):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value).otherwise(found) if found is not None else F.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def decoded(href: Column) -> Column:
    """``&`` out of its references, in the forms that stand in attributes."""
    return F.regexp_replace(href, r"(?i)&amp;|&#0*38;|&#x0*26;", "&")


def resolved(target: Column, base: Column) -> Column:
    """A link's target as an absolute url: by the scheme, host and path of the page it stands on; null without a base that has them."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path, query = path_of(base), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?", 1))
    # path and rest of a relative target; dots are taken out of the path alone
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(site, F.lit("/"), F.array_join(kept, "/"), ends, rest)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (target == "") | (site == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("#"), F.concat(site, path, query, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(plain)
    )


def canonical_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): a page's url and each url that its canonical links and refreshes name, absolute."""
    html = F.col("html")
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    found = pages.select("url", F.explode(F.concat(link, refresh)).alias("target"))
    return found.select(F.col("url").alias("src"), resolved(decoded(F.col("target")), F.col("url")).alias("dst")).where(F.col("dst").isNotNull())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) and, if given, redirects (src, dst) -> page_id, host, path, rule, verdict."""
    edges = canonical_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst")).distinct()
    members = connected_components(edges)
    ruled = members.withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    # one decision for each component; a hub of many aliases is summed up before it is shuffled
    decisions = ruled.groupBy("component").agg(F.max(F.col("r.verdict") == "block").alias("blocks"), F.max(F.col("r.verdict") == "allow").alias("allows"))
    blocked = members.join(decisions.where(F.col("blocks") & ~F.coalesce(F.col("allows"), F.lit(False))), "component").select(F.col("node").alias("key"), F.lit("block").alias("inherited"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(blocked, "key", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "inherited", F.lit("allow")).alias("verdict")
    )


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, regexp_extract(url, '(?s)^([^#]*)', 1) AS key, html,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), rules(verdict, rule, name, start) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), links AS (
  SELECT key AS a, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>|<meta\b[^>]*>')), '(?is)(?:rel\s*=\s*["'']?canonical\b.*\bhref\s*=\s*["'']?|http-equiv\s*=\s*["'']?refresh\b.*url=)([^"''\s>]+)', 1) AS b FROM u
), edges AS (
  SELECT a, regexp_extract(b, '^([^#]*)', 1) AS b FROM links WHERE instr(b, '://') > 0
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
  SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), nodes AS (
  SELECT DISTINCT b AS key, coalesce(translate(regexp_extract(substr(b, instr(b, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         regexp_extract(substr(b, instr(b, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path
  FROM reach
), node_verdict AS (
  SELECT key, arg_max(verdict, length(rule)) AS verdict FROM nodes JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY key
), inherited AS (
  SELECT r.a AS key FROM reach r JOIN node_verdict v ON v.key = r.b GROUP BY r.a HAVING bool_or(v.verdict = 'block') AND NOT bool_or(v.verdict = 'allow')
), fit AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY host, path
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN i.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN fit f ON f.host = u.host AND f.path = u.path LEFT JOIN inherited i ON i.key = u.key
"""


def query(spark, sf_dir):
    """op5: every page's url judged by the standing rules."""
    from codexa.llm.common import table

    return judge(table(spark, sf_dir, "pages"))
