"""URL filter with redirect equivalence.

Every url is judged by the longest allow or block rule that fits it.  Urls that stand for one page form a class: the
connected components over edges from a page to its canonical link, to the target of a ``refresh`` redirect, to given
redirects, and to its canonical form (no ``www.``/``m.``, no tracking parameters, fragment, trailing slash or
``.html``).  A url without a rule of its own is blocked if any url of its class is blocked by a rule; an explicit allow
always precedes that, and decides between rules of one length.

A url meets only rules that fit it: the suffixes of its host that have rules bring the lengths that these rules' paths
have, and (suffix, beginning of the path) is looked up for each.  A host with very many rules so costs as many look-ups
as they have lengths.  Only urls and 16-byte keys are shuffled, never pages.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, has no alias and is allowed;
repeated rows are repeated; null html has no links; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import lower_ascii, stored
from lattix.llm.components import connected_components

Rule = tuple[str, str, str]  # action, host, path
#: Rule lists up to this many are broadcast; longer ones are joined.
BROADCAST_RULES = 20_000

HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
QUERY = r"://[^?#]*\?([^#]*)"
TRACKING = "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
LINK_TAG = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
META_TAG = r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF, META_URL = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Key of a url, without its fragment; null where there is no host part."""
    return F.when(url.contains("://"), F.unhex(F.md5(F.concat(F.lit("u"), F.substring_index(url, "#", 1)).cast("binary"))))


def canonical_node_of(url: Column) -> Column:
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, QUERY, 1), TRACKING, ""), "^&", "")
    return F.when(url.contains("://"), F.unhex(F.md5(F.concat(F.lit("c"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).cast("binary"))))


def resolved(link: Column, url: Column) -> Column:
    """The absolute form of a link on a page; null for an empty one."""
    scheme = F.regexp_extract(url, "^([^:/?#]*):", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(url, HOST, 1))
    folder = F.regexp_replace(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), "[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, folder, link))
    )


def with_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (host and path of the longest rule that fits, else null) and ``action`` to distinct urls with host and path."""
    spark = urls.sparkSession
    small = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    table = spark.createDataFrame(rules, "action string, r_host string, r_path string").groupBy("r_host", "r_path").agg(F.min("action").alias("action"))  # of one rule twice, the allow
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))  # as many as a path has characters, at most
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("r_host")).join(small(lengths), "r_host")
    tried = tried.select("url", "path", "r_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    fits = tried.select("url", "r_host", F.expr("left(path, n)").alias("r_path")).join(small(table), ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("len"), (F.col("action") == "allow").alias("allows"), rule.alias("rule"), "action")).alias("best"))
    return urls.join(best.select(F.col("url").alias("__url"), "best"), F.col("url") == F.col("__url"), "left").select(*urls.columns, "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) to page_id, host, path, rule, verdict and ``alias_of_blocked``.
    ``redirects`` may hold further (from_url, to_url) rows."""
    tag = lambda t, a: F.regexp_extract(F.regexp_extract("html", t, 0), a, 1)
    url = F.col("url")
    base = pages.select(
        "page_id",
        "url",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.array_compact(F.array(resolved(tag(LINK_TAG, HREF), url), resolved(tag(META_TAG, META_URL), url))).alias("links"),
    )
    base = stored(base, "urls")
    links = base.where("url is not null").select(F.col("url").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    others = links.select(F.explode(F.array("a", "b")).alias("url")).where("url is not null")
    urls = base.select("url").unionByName(others).where("url is not null").distinct()
    edges = links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
    edges = edges.unionByName(urls.select(node_of(F.col("url")).alias("a"), canonical_node_of(F.col("url")).alias("b")))
    classes = connected_components(edges)

    judged = with_rules(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    judged = judged.select("url", "rule", "action", node_of(F.col("url")).alias("node"))
    placed = stored(judged.join(classes, "node", "left"), "judged")
    blocked = placed.where("action = 'block' and component is not null").select("component").distinct().withColumn("in_blocked", F.lit(True))
    placed = placed.join(blocked, "component", "left").select("url", "rule", "action", F.coalesce("in_blocked", F.lit(False)).alias("in_blocked"))
    out = base.join(placed, "url", "left")
    alias = F.col("action").isNull() & F.coalesce("in_blocked", F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias_of_blocked")
    )


def verdict_sql(rules: list[Rule], pages: str, redirects: str = "") -> str:
    """The same judgement as SQL for DuckDB: blocked urls spread over the edges by recursion.  ``redirects`` may be a select
    of further (a, b) urls."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(h)}, {quote(p)})" for a, h, p in rules)
    host = f"translate(regexp_extract({{u}}, '{HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({{u}}, '{PATH}', 1)"
    h, p, u = host.format(u="url"), path.format(u="url"), "url"
    tag = lambda t, a: f"regexp_extract(regexp_extract(html, {quote(t)}, 0), {quote(a)}, 1)"
    return rf"""
with recursive rules(action, r_host, r_path) as (values {values}),
p as (
  select page_id, url, coalesce({h}, '') as host, coalesce({p}, '') as path, regexp_extract(url, '^([^:/?#]*):', 1) as scheme,
         regexp_extract(url, '{HOST}', 1) as raw_host, {tag(LINK_TAG, HREF)} as l1, {tag(META_TAG, META_URL)} as l2
  from {pages}),
raw_links as (select url, scheme, raw_host, path, l1 as l from p union all select url, scheme, raw_host, path, l2 from p),
links as (
  select url as a, case
    when contains(l, '://') then l
    when starts_with(l, '//') then scheme || ':' || l
    when starts_with(l, '/') then scheme || '://' || raw_host || l
    else scheme || '://' || raw_host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || l end as b
  from raw_links where url is not null and l is not null and l <> ''{" union all " + redirects if redirects else ""}),
urls as (select url from p where url is not null union select a from links where a is not null union select b from links where b is not null),
forms as (
  select url, 'u' || split_part(url, '#', 1) as node,
         'c' || regexp_replace({h}, '^(www|m)\.', '') || regexp_replace({p}, '(\.html?|/)$', '') || coalesce('?' || nullif(regexp_replace(
           regexp_replace(regexp_extract(url, '{QUERY}', 1), '{TRACKING}', '', 'g'), '^&', ''), ''), '') as form
  from urls where contains(url, '://')),
edges as (
  select node as a, form as b from forms union
  select 'u' || split_part(a, '#', 1), 'u' || split_part(b, '#', 1) from links where contains(a, '://') and contains(b, '://')),
both_ways as (select a, b from edges union select b, a from edges),
fits as (
  select u.url, r.action, r.r_host || r.r_path as rule,
         row_number() over (partition by u.url order by length(r.r_host || r.r_path) desc, r.action asc, r.r_host || r.r_path desc) as k
  from (select url, {h} as host, {p} as path from urls) u join rules r
    on (u.host = r.r_host or ends_with(u.host, '.' || r.r_host)) and starts_with(u.path, r.r_path)),
best as (select url, action, rule from fits where k = 1),
reach(node) as (
  select 'u' || split_part(url, '#', 1) from best where action = 'block' and contains(url, '://')
  union select b from both_ways join reach on a = node)
select page_id, host, path, rule, coalesce(action, case when reach.node is not null then 'block' else 'allow' end) as verdict,
       (action is null and reach.node is not null) as alias_of_blocked
from p left join best on p.url = best.url left join reach on reach.node = 'u' || split_part(p.url, '#', 1)
"""
