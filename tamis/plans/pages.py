"""Registered queries on collected pages, feeds and Markdown, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import web
from tamis.plans import derived_sql as ds
from tamis.sources.tables import table


def _q(f):
    return lambda spark, folder: f(table(spark, folder, "pages"))


def _feeds(p):
    """A feed of three items for every page: RSS for even numbers, Atom for odd ones."""
    told = F.substring(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>|[<>&\\]]", " "), 1, 300)
    n = F.col("page_id").cast("string")
    rss = lambda i, link: F.concat(F.lit(f"<item><title>Item {i} of "), n, F.lit(f"</title><link>{link}"), n, F.lit("</link><description><![CDATA["), told, F.lit("]]></description></item>"))
    atom = lambda i, link: F.concat(F.lit(f"<entry><title>Entry {i} of "), n, F.lit(f'</title><link rel="x" href="{link}'), n, F.lit('"/><summary>&lt;'), told, F.lit("</summary></entry>"))
    links = ["https://host.example/a", "/b", "javascript:c"]
    xml = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<rss><channel><title>t</title>"), *[rss(i, x) for i, x in enumerate(links)], F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed><title>t</title>"), *[atom(i, x) for i, x in enumerate(links)], F.lit("</feed>")))
    return p.select("page_id", "url", xml.alias("xml"))


def _items(p):
    items = web.feed_items(_feeds(p)).join(p.select(F.col("page_id").alias("_p"), "url"), F.col("page_id") == F.col("_p"))
    return items.select("page_id", "n", "title", web.safe_link(F.col("link"), F.col("url")).alias("link"), "description")


def _markdown(d):
    t = F.concat(F.lit("# Title\n**"), F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit("** and _so_ [a](b) ![c](d) `e`\n> quote\n---\n```py\ncode\n```\n"), F.coalesce("text", F.lit("")))
    return d.select(F.concat(F.lit("d/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".bin")).alias("path"), t.alias("content"))


QUERIES = {
    "web_titles": _q(web.page_titles),
    "web_text": _q(web.page_text),
    "web_collect": _q(lambda p: web.collect_pages(p)),
    "web_feed_items": _q(_items),
    "web_feed_budget": _q(lambda p: web.feed_budget(_items(p), 2, 550).select("page_id", "n")),
    "web_feed_trust": _q(lambda p: web.trust_rollup(_items(p).select("page_id", F.when(F.col("n") < F.col("page_id") % 4, "allow").otherwise("warn").alias("verdict")))),
    "doc_markdown": lambda s, f: _markdown(table(s, f, "documents")).select("path", F.sha2(web.markdown_text(F.col("content")), 256).alias("sha")),
    "doc_parsed": lambda s, f: web.parse_documents(_markdown(table(s, f, "documents"))).select("path", "kind", "chunk_index", "start_offset"),
}

_BLANK = "[ \\t\\n\\r\\f\\x0B\\x{00A0}\\x{FEFF}]+"
_TRIM = lambda c: f"regexp_replace({c}, '^{_BLANK}|{_BLANK}$', '', 'g')"
_BARE = lambda c: _TRIM(f"regexp_replace({c}, '<[^>]*>', '', 'g')")


def _noise(c: str) -> str:
    for tag in web.NOISE_TAGS:
        c = f"regexp_replace({c}, '(?is)<{tag}.*?</{tag}>', '', 'g')"
    return c


def _strip(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '(?i)<br[ \\t\\n\\r\\f]*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?i)</(?:div|li)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return _TRIM(f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _decode(c: str) -> str:
    """One pass over the entities: what stands between two of them is kept, each of them is looked up."""
    ref = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|nbsp|lt|gt|quot|apos|amp);"
    one = "CASE e WHEN '&nbsp;' THEN ' ' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN '''' WHEN '&amp;' THEN '&' ELSE chr(CAST(CASE WHEN regexp_matches(e, '^&#[xX]') THEN '0x' || regexp_extract(e, '^&#[xX]([0-9a-fA-F]+);', 1) ELSE regexp_extract(e, '^&#([0-9]+);', 1) END AS INT)) END"
    return f"(SELECT string_agg(coalesce(p, '') || coalesce({one}, ''), '' ORDER BY i) FROM (SELECT unnest(range(len(ps))) AS i, unnest(ps) AS p, unnest(list_append(es, NULL)) AS e FROM (SELECT string_split_regex({c}, '{ref}') AS ps, regexp_extract_all({c}, '{ref}') AS es)))"


_FEED_TEXT = "substr(regexp_replace(coalesce(html, ''), '<[^>]*>|[<>&\\]]', ' ', 'g'), 1, 300)"
_LINKS = ["https://host.example/a", "/b", "javascript:c"]
_RESOLVED = "CASE i WHEN 0 THEN 'https://host.example/a' || page_id WHEN 1 THEN nullif(regexp_extract(url, '^(https?://[^/?#]+)', 1), '') || '/b' || page_id END"
_ITEMS = f"items AS (SELECT page_id, CAST(i AS INT) AS n, CASE WHEN page_id % 2 = 0 THEN 'Item ' ELSE 'Entry ' END || i || ' of ' || page_id AS title, {_RESOLVED} AS link, CASE WHEN page_id % 2 = 0 THEN trim({_FEED_TEXT}) ELSE trim('&lt;' || {_FEED_TEXT}) END AS description FROM pages, (SELECT unnest(range(3)) AS i))"

ORACLE = {
    "web_titles": f"SELECT page_id, {_decode('t')} AS title FROM (SELECT page_id, regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS t FROM pages)",
    "web_text": f"""WITH c AS (SELECT page_id, {_noise("coalesce(html, '')")} AS h FROM pages),
p AS (SELECT page_id, h, regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1) AS a, regexp_extract(h, '(?is)<main[^>]*>(.*?)</main>', 1) AS m, regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1) AS b, regexp_extract_all(h, '(?is)<(?:div|section)[^>]*>(.*?)</(?:div|section)>', 1) AS blocks FROM c),
r AS (SELECT page_id, arg_max(inner_, (score, -i)) AS dense FROM (SELECT page_id, i, inner_, length({_BARE('inner_')}) * length({_BARE('inner_')}) / greatest(length(inner_), 1) AS score, length({_BARE('inner_')}) AS n FROM (SELECT page_id, unnest(range(len(blocks))) AS i, unnest(blocks) AS inner_ FROM p)) WHERE n >= 200 GROUP BY page_id),
s AS (SELECT page_id, {_strip(f"CASE WHEN length({_BARE('a')}) > 200 THEN a WHEN length({_BARE('m')}) > 200 THEN m WHEN dense IS NOT NULL THEN dense WHEN b <> '' THEN b ELSE h END")} AS t FROM p LEFT JOIN r USING (page_id))
SELECT page_id, coalesce({_decode('t')}, '') AS text FROM s""",
    "web_feed_items": f"WITH {_ITEMS} SELECT * FROM items",
    "web_feed_budget": f"WITH {_ITEMS} SELECT page_id, n FROM (SELECT page_id, n, sum(length(description)) OVER (PARTITION BY page_id ORDER BY n) AS spent FROM items) WHERE n < 2 AND spent <= 550",
    "web_feed_trust": "SELECT page_id, 3 AS items, least(page_id % 4, 3) AS stored, CASE WHEN page_id % 4 >= 3 THEN 'stored' WHEN page_id % 4 = 0 THEN 'quarantined' ELSE 'partial' END AS persistence FROM pages",
}
