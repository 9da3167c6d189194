r"""URL filter with redirect equivalence, in DataFrame operations only.

A rule is (action, host, path).  It fits a url whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path; the longest rule that fits
decides, allow before block among rules of one length.

Urls are aliases if redirects or canonical links connect them: every ``<link rel=canonical>``
and ``<meta http-equiv=refresh>`` of a page, absolute or relative, and any table of
redirects the caller has.
Connected components over those edges are found by distributed star contraction.  If
any url of a component is blocked by a rule, the block reaches its aliases, but a page
with an explicit allow of its own stays allowed.  All else is allowed.

A url's node is its host and path without scheme, user, port 80 or 443, fragment, dot
segments, trailing slashes and ``utm_`` parameters, so spellings of one address are one node.

Results for odd input: a null url, or one without ``://``, has empty host and path, no
node, no rule and is allowed; null html has no links; repeated rows are judged alike;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.graph import connected_components
from pixelloom.session import materialize

#: The rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_TAGS = r"(?i)<(?:link|meta|base)\s[^>]*>"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([\s\S]*)$", 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """The url's node among aliases; null where the url has no host."""
    rest = F.regexp_replace(_rest(url), r"#[\s\S]*$", "")
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(_without_dots(path_of(url)), r"/+$", "")
    query = F.regexp_extract(rest, r"\?([\s\S]*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _chosen(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], give) -> Column:
    """The longest fitting rule's ``give(rule)``; null if none fits."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, give(rule)) if out is None else out.when(fits, give(rule))
    return out if out is not None else F.lit(None).cast("string")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it is written; empty without one."""
    pattern = r"(?i)(?<=[\s\"'/])" + name + _VALUE
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def _decoded(text: Column) -> Column:
    """Numeric references to ASCII characters and the five named ones of XML."""

    def one(piece: Column) -> Column:
        hexed, plain = F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(piece, r"^([0-9]{1,7});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("int")
        return F.when(code.between(32, 126), F.concat(F.char(code), F.regexp_replace(piece, r"^[xX]?[0-9a-fA-F]+;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    pieces = F.split(text, "&#", -1)
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    out = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(text.contains("&"), out).otherwise(text)


def absolute(target: Column, base: Column) -> Column:
    """What a link on a page with the address ``base`` leads to; null if to no host, or to itself."""
    scheme, authority = F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1)
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    after = F.regexp_extract(target, r"^[^?#]*([\s\S]*)$", 1)
    site = F.concat(scheme, F.lit("://"), authority)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path_of(base), r"[^/]*$", ""), r"^/", ""))
    placed = F.when(path == "", path_of(base)).when(path.startswith("/"), _without_dots(path)).otherwise(_without_dots(F.concat(folder, path)))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(authority == "", F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(site, placed, after))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url) of all canonical links and refresh redirects of the pages.

    Targets may be relative in any way, to the page's address or to its first ``<base>``;
    what stands in comments does not count.
    """
    # a select for each step: what several expressions of the next one use is computed once
    may = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    bare = may.select(F.col("url").alias("src_url"), F.regexp_replace("html", r"(?s)<!--.*?-->", "").alias("html"))
    tags = bare.select("src_url", F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)).alias("tags"))
    hrefs = F.transform(F.filter("tags", lambda t: F.lower(t).startswith("<base")), lambda t: _attribute(t, "href"))
    based = tags.select("src_url", "tags", F.get(F.filter(hrefs, lambda t: t != ""), F.lit(0)).alias("base"))
    based = based.select("src_url", "tags", F.trim(_decoded(F.col("base"))).alias("base"))
    based = based.select("src_url", "tags", F.coalesce(absolute(F.col("base"), F.col("src_url")), "src_url").alias("base"))
    one = based.select("src_url", "base", F.explode("tags").alias("tag"))
    names = {"rel": "rel", "href": "href", "equiv": "http-equiv", "content": "content"}
    raw = one.select("src_url", "base", F.lower(F.substring("tag", 1, 5)).alias("kind"), *(_attribute(F.col("tag"), name).alias(c) for c, name in names.items()))
    read = raw.select("src_url", "base", "kind", *(F.trim(_decoded(F.col(c))).alias(c) for c in names))
    canonical = (F.col("kind") == "<link") & F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = (F.col("kind") == "<meta") & (F.lower("equiv") == "refresh")
    goto = F.regexp_extract("content", r"(?i)^[0-9.\s]*[;,\s]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1)
    aimed = read.select("src_url", "base", F.when(canonical, F.col("href")).when(refresh, F.trim(goto)).alias("target")).where("target <> ''")
    return aimed.select("src_url", absolute(F.col("target"), F.col("base")).alias("dst_url")).where("dst_url is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    redirects: further edges as (src_url, dst_url).
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src_url", "dst_url"))
    links = materialize(links.distinct(), "links")
    edges = links.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
    parts = connected_components(edges)

    urls = pages.select("url").unionByName(links.select(F.explode(F.array("src_url", "dst_url")).alias("url")))
    ruled = _chosen(host_of(F.col("url")), path_of(F.col("url")), rules, lambda r: F.lit(r[0]))
    blocked = urls.where(ruled == "block").select(node_of(F.col("url")).alias("id")).distinct()
    bad = parts.join(blocked, "id", "left_semi").select("component").distinct()
    reached = materialize(parts.join(bad, "component", "left_semi").select("id").unionByName(blocked).distinct(), "blocked")

    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("rule", _chosen(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[1] + r[2])))
    own = own.withColumn("ruled", _chosen(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[0])))
    judged = own.join(reached.withColumn("hit", F.lit(True)), F.col("node") == F.col("id"), "left")
    verdict = F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_alias_verdicts(spark, sf_dir: str) -> DataFrame:
    """The same operator where links decide: a page for each row of ``pages``, on 40 hosts.

    A page links to the page 40 rows before, in one of eight spellings by its number, or
    not at all; the table of the registered query has no such links.
    """
    k = F.col("page_id")
    folder = lambda n: F.element_at(F.array(*(F.lit(x) for x in FOLDERS)), (n % len(FOLDERS) + 1).cast("int"))
    site = lambda n: F.concat(F.lit("http://s"), (n % 40).cast("string"), F.lit(".com"))
    name = lambda n: F.concat(n.cast("string"), F.lit(".html"))
    there = k - 40
    whole = F.concat(site(there), F.lit("/"), folder(there), F.lit("/"), name(there))
    link = lambda href: F.concat(F.lit('<link rel="canonical" href="'), href, F.lit('">'))
    forms = (
        link(whole),
        link(F.concat(F.lit("../"), folder(there), F.lit("/"), name(there))),
        link(F.concat(F.lit("/"), folder(there), F.lit("/./"), name(there))),
        F.concat(F.lit("<!-- <link rel=canonical href=http://none.com/> --><link href='//"), F.replace(whole, F.lit("http://"), F.lit("")), F.lit("?utm_a=1&amp;utm_b=2#top' rel='shortlink canonical'>")),
        F.concat(F.lit('<META content="0; URL='), F.lit("'"), whole, F.lit("'"), F.lit('" http-equiv=Refresh>')),
        F.concat(F.lit("<base href='/a/b/'>"), link(F.concat(F.lit("../../"), folder(there), F.lit("&#x2F;"), name(there)))),
        F.concat(link(F.lit("#self")), link(whole), F.lit("<link rel='nocanonical' href='http://none.com/de/'>")),
        F.lit("<link rel='next' href='http://none.com/de/'>"),
    )
    html = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null")
    url = F.concat(site(k), F.lit("/"), folder(k), F.lit("/"), name(k))
    made = pages.select(k.cast("bigint").alias("page_id")).select("page_id", url.alias("url"), F.when(k >= 40, html).alias("html"))
    return judge(made).select("page_id", "host", "path", "rule", "verdict")


FOLDERS = ("en", "es", "en", "fr", "it", "en", "it", "nl", "en", "pt", "de")

#: Aliases by row numbers alone: no link is read from a page's text.
ALIAS_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, ['en', 'es', 'en', 'fr', 'it', 'en', 'it', 'nl', 'en', 'pt', 'de'][page_id % 11 + 1] AS folder
  FROM pages WHERE page_id IS NOT NULL),
ids AS (SELECT DISTINCT page_id FROM p),
edges AS (SELECT page_id AS x, page_id - 40 AS y FROM ids WHERE page_id >= 40 AND page_id % 8 <> 7),
blocked AS (
  SELECT DISTINCT page_id AS n FROM p WHERE folder = 'de'
  UNION SELECT y FROM edges WHERE y % 11 = 10),
reached AS (
  SELECT n FROM blocked
  UNION
  SELECT CASE WHEN r.n = e.x THEN e.y ELSE e.x END FROM reached r JOIN edges e ON r.n = e.x OR r.n = e.y)
SELECT page_id, 's' || (page_id % 40) || '.com' AS host, '/' || folder || '/' || page_id || '.html' AS path,
       CASE folder WHEN 'fr' THEN 'com/fr/' WHEN 'de' THEN 'com/de/' END AS rule,
       CASE WHEN folder = 'fr' THEN 'allow' WHEN page_id IN (SELECT n FROM reached) THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""

#: Reads links tag by tag, cut at ``<``; without ``<base>``, dot segments and numeric references.
OP6_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(string_split(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '<')) AS piece FROM pages WHERE url IS NOT NULL),
wanted AS (
  SELECT url AS src_url, split_part(piece, '>', 1) AS tag FROM tags
  WHERE piece ILIKE 'link%canonical%' OR piece ILIKE 'meta%refresh%'),
targets AS (
  SELECT src_url, trim(replace(CASE
           WHEN tag ILIKE 'link%' THEN regexp_extract(tag, '(?i)[\s"'']href\s*=\s*["'']?([^"''\s>]+)', 1)
           ELSE regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&')) AS target,
         regexp_extract(src_url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(src_url, '://([^/?#]*)', 1) AS authority,
         regexp_extract(src_url, '://[^/?#]*([^?#]*)', 1) AS page_path
  FROM wanted),
joined AS (
  SELECT DISTINCT src_url, CASE
    WHEN target = '' OR starts_with(target, '#') THEN NULL
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR authority = '' THEN NULL
    WHEN starts_with(target, '//') THEN scheme || ':' || target
    WHEN starts_with(target, '/') THEN scheme || '://' || authority || target
    WHEN starts_with(target, '?') THEN scheme || '://' || authority || page_path || target
    ELSE scheme || '://' || authority || CASE WHEN page_path = '' THEN '/' ELSE regexp_extract(page_path, '^(.*/)', 1) END || target END AS dst_url
  FROM targets),
links AS (SELECT src_url, dst_url FROM joined WHERE dst_url IS NOT NULL),
named AS (
  SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src_url FROM links UNION ALL SELECT dst_url FROM links)),
parts AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM named),
cut AS (
  SELECT url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(regexp_replace(coalesce(rest, ''), '#(?s:.*)$', ''), '\?((?s:.*))$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM parts),
judged AS (
  SELECT url, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS node,
         (SELECT r.rule FROM (VALUES ('org/', 'org', '/'), ('example.org/es/', 'example.org', '/es/'), ('example.org/en/1', 'example.org', '/en/1'), ('com/fr/', 'com', '/fr/'), ('com/de/', 'com', '/de/')) r(rule, h, p)
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(r.rule) DESC LIMIT 1) AS rule
  FROM cut),
ruled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM judged),
edges AS (
  SELECT a.node AS x, b.node AS y FROM links l JOIN judged a ON l.src_url = a.url JOIN judged b ON l.dst_url = b.url WHERE a.node <> b.node),
reached AS (
  SELECT node FROM ruled WHERE action = 'block' AND node IS NOT NULL
  UNION
  SELECT CASE WHEN r.node = e.x THEN e.y ELSE e.x END FROM reached r JOIN edges e ON r.node = e.x OR r.node = e.y)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
       coalesce(r.action, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN ruled r ON p.url IS NOT DISTINCT FROM r.url LEFT JOIN (SELECT DISTINCT node FROM reached) b ON r.node = b.node
"""
