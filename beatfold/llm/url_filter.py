"""URL filters by rules, with decisions carried over redirects and canonical links.

A url's own rule decides where one fits. A url without one takes the decision of its aliases: the urls joined to it, directly or
by a chain, by redirects (meta refresh, or a given table) and canonical links. Aliases are connected components; one that holds
an explicit allow is allowed, else one that holds a block is blocked, else the default holds. DataFrame functions only.

Nulls: a null url, or one without "://", has an empty host and path, fits no rule, has no aliases and gets the default. A null
html has no links. A null page_id stays. Repeated rows are judged alike. Two rules of one length cannot both fit with different
hosts; of equal texts allow goes first. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common
from beatfold.llm.components import components

#: The rules of the registered query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MOST_RULES = 1000
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; nulls if none does. The rules are a configured list of at most MOST_RULES."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be part of a plan")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in order]
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (v, h, p) in zip(reversed(fits), reversed(order), strict=True):
        text, verdict = F.when(fit, F.lit(h + p)).otherwise(text), F.when(fit, F.lit(v)).otherwise(verdict)
    return text, verdict


def alias_key(url: Column) -> Column:
    """What names a url as an alias: host, path and query, without scheme and fragment; null without "://"."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def resolved(target: Column, base: Column) -> Column:
    """A link target as an absolute url: absolute, scheme-relative, host-relative or path-relative; null if empty."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(base), target))
        .otherwise(F.concat(root, folder, target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): pairs of absolute urls joined by a canonical link or a meta refresh of a page (url, html)."""
    html = F.col("html")
    named = pages.filter("instr(url, '://') > 0 AND html IS NOT NULL").filter(F.col("html").ilike("%canonical%") | html.ilike("%refresh%"))
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(LINK), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    links = named.select(F.col("url").alias("a"), F.explode(tags).alias("to"))
    return links.select("a", resolved(F.col("to"), F.col("a")).alias("b")).filter("b IS NOT NULL")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """(<id_col>, host, path, rule, verdict, verdict_from): verdict_from is 'rule', 'alias' or 'default'.

    pages: (<id_col>, url, html); redirects: (from_url, to_url), if crawled redirects are at hand.
    """
    pages = common.pick(pages, id_col, "url", "html")
    links = page_links(pages)
    if redirects is not None:
        r = common.pick(redirects, "from_url", "to_url")
        links = links.union(r.select("from_url", resolved(F.col("to_url"), F.col("from_url"))))
    links = common.written(links.select(alias_key(F.col("a")).alias("a"), alias_key(F.col("b")).alias("b")).filter("a <> b").distinct(), "url-links")
    comps = components(links)
    _, verdict = matched(F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1), rules)
    decided = comps.withColumn("v", verdict).filter("v IS NOT NULL").groupBy("comp").agg(F.min("v").alias("alias_verdict"))  # 'allow' sorts before 'block'
    aliases = comps.join(decided, "comp").select(F.col("node").alias("key"), "alias_verdict")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select(id_col, host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("key"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("own", verdict).join(aliases, "key", "left")
    return own.select(
        id_col, "host", "path", "rule",
        F.coalesce("own", "alias_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("verdict_from"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).drop("verdict_from")


def _sql_rule(host: str, path: str, what: str) -> str:
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    value = {"text": lambda v, h, p: h + p, "verdict": lambda v, h, p: v}[what]
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{value(v, h, p)}'" for v, h, p in order) + " END"


def _sql_part(url: str, part: str) -> str:
    if part == "host":
        return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_key(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN {_sql_part(url, 'host')} || {_sql_part(url, 'path')} || coalesce(regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1), '') END"


def _sql_quote(pattern: str) -> str:
    return "'" + pattern.replace('\\"', '"').replace("'", "''") + "'"


OP6_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url AS a, replace(regexp_extract(t, {_sql_quote(HREF)}, 1), '&amp;', '&') AS t
  FROM (SELECT url, unnest(regexp_extract_all(html, {_sql_quote(LINK)})) AS t FROM pages WHERE instr(url, '://') > 0 AND html ILIKE '%canonical%')
  UNION ALL
  SELECT url, replace(regexp_extract(t, {_sql_quote(TARGET)}, 1), '&amp;', '&')
  FROM (SELECT url, unnest(regexp_extract_all(html, {_sql_quote(REFRESH)})) AS t FROM pages WHERE instr(url, '://') > 0 AND html ILIKE '%refresh%')
), based AS (
  SELECT a, t, regexp_extract(a, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1) AS h, {_sql_part("a", "path")} AS p FROM tags
), links AS (
  SELECT a, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '/') THEN scheme || '://' || h || t
    WHEN starts_with(t, '?') THEN scheme || '://' || h || p || t
    ELSE scheme || '://' || h || coalesce(nullif(regexp_replace(p, '[^/]*$', ''), ''), '/') || t END AS b
  FROM based
), edges AS (
  SELECT {_sql_key("a")} AS a, {_sql_key("b")} AS b FROM links WHERE b IS NOT NULL
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), decided AS (
  SELECT a AS key, min({_sql_rule("regexp_extract(b, '(?s)^([^/?#]*)', 1)", "regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1)", "verdict")}) AS v FROM reach GROUP BY a
), own AS (
  SELECT page_id, {_sql_part("url", "host")} AS host, {_sql_part("url", "path")} AS path, {_sql_key("url")} AS key FROM pages
)
SELECT page_id, host, path, {_sql_rule("host", "path", "text")} AS rule,
  coalesce({_sql_rule("host", "path", "verdict")}, v, 'allow') AS verdict
FROM own LEFT JOIN decided USING (key)
"""
