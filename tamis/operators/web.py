"""Collected pages: titles, main text, domains, feeds, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import text_or_empty

#: Entities of text, in the order in which they are decoded. Fixed values.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Elements that hold no main text. Fixed values.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "noscript")


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Text with numeric entities, decimal and hexadecimal, and the named ones of text decoded; code points that do not exist
    stay as they are written."""
    c = F.regexp_replace(c, "(?i)&#(?:0*38|x0*26);", "&amp;")  # decoded last, so that nothing is decoded twice
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("&#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def one(text, ref):
        n = F.when(F.lower(ref).startswith("x"), F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("bigint")
        good = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(good, F.replace(text, F.concat(F.lit("&#"), ref, F.lit(";")), _code_point(n))).otherwise(text)

    c = F.when(c.contains("&#"), F.aggregate(found, c, one)).otherwise(c)
    for name, ch in NAMED:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def page_titles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title): the first title element, trimmed and decoded; empty where there is none."""
    found = F.regexp_extract(text_or_empty(html_col), "(?is)<title[^>]*>(.*?)</title>", 1)
    rows = pages.select(id_col, F.regexp_replace(found, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "").alias("t"))
    return rows.select(id_col, decode_entities(F.col("t")).alias("title"))


def page_domains(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, domain): the host without www., as a slug of 80 characters at most; web where there is none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), "^www\\.", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(host, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""), 1, 80)
    return pages.select(id_col, F.when(F.coalesce(slug, F.lit("")) == "", "web").otherwise(slug).alias("domain"))


def without_noise(rows: DataFrame, c: str) -> DataFrame:
    """rows with the elements that hold no main text taken out of c. The part behind the last end of an element, in which none
    ends, is left alone, so that a lazy pattern never runs to the end of a page for an element that is not closed."""
    for tag in NOISE_TAGS:
        end = f"</{tag}>"
        rows = rows.withColumn("_rest", F.when(F.lower(c).contains(end), F.length(F.substring_index(F.lower(c), end, -1))))
        clean = F.concat(F.regexp_replace(F.left(c, F.length(c) - F.col("_rest")), f"(?is)<{tag}.*?</{tag}>", ""), F.right(c, F.col("_rest")))
        rows = rows.withColumn(c, F.when(F.col("_rest").isNotNull(), clean).otherwise(F.col(c)))
    return rows.drop("_rest")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "^[ \\t\\n\\r\\f\\x0B\\u00A0\\uFEFF]+|[ \\t\\n\\r\\f\\x0B\\u00A0\\uFEFF]+$", "")


def strip_tags(c: Column) -> Column:
    """Text of markup: a paragraph's end becomes an empty line, other block ends and breaks a line end, other tags go."""
    c = F.regexp_replace(F.regexp_replace(c, "(?i)<br[ \\t\\n\\r\\f]*/?>", "\n"), "(?i)</p>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)</(?:div|li)>", "\n"), "<[^>]*>", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(c, "^[ \\t\\n\\r\\f\\x0B\\u00A0\\uFEFF]+|[ \\t\\n\\r\\f\\x0B\\u00A0\\uFEFF]+$", "")


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): of the article or main element if its text is longer than 200 characters; else of the div or section, up to
    the first end, of 200 characters of text or more with the most text times density; else of the body, or of the page."""
    clean = without_noise(pages.select(id_col, text_or_empty(html_col).alias("h")), "h")
    part = lambda tag: F.when(F.lower("h").contains(f"</{tag}>"), F.regexp_extract("h", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)).otherwise("")
    blocks = F.regexp_extract_all("h", F.lit("(?is)<(?:div|section)[^>]*>(.*?)</(?:div|section)>"), F.lit(1))
    rows = clean.select(id_col, "h", part("article").alias("article"), part("main").alias("main"), part("body").alias("body"), blocks.alias("blocks"))
    rated = F.transform("blocks", lambda b, i: F.struct((F.length(_bare(b)) * F.length(_bare(b)) / F.greatest(F.length(b), F.lit(1))).alias("score"), (-i).alias("i"), b.alias("inner"), F.length(_bare(b)).alias("n")))
    dense = F.array_max(F.filter(rated, lambda r: r["n"] >= 200))["inner"]
    content = F.when(F.length(_bare(F.col("article"))) > 200, F.col("article")).when(F.length(_bare(F.col("main"))) > 200, F.col("main")).when(dense.isNotNull(), dense).when(F.col("body") != "", F.col("body")).otherwise(F.col("h"))
    return rows.select(id_col, strip_tags(content).alias("t")).select(id_col, decode_entities(F.col("t")).alias("text"))


def feed_items(feeds: DataFrame, id_col: str = "page_id", xml_col: str = "xml") -> DataFrame:
    """(id, n, title, link, description): items of RSS and entries of Atom, malformed feeds included; CDATA is unwrapped and a
    description in markup becomes text."""
    xml = text_or_empty(xml_col)
    atom = xml.rlike("(?i)<feed[ \\t\\n\\r\\f>]")
    items = F.when(atom, F.regexp_extract_all(xml, F.lit("(?is)<entry>(.*?)</entry>"), F.lit(1))).otherwise(F.regexp_extract_all(xml, F.lit("(?is)<item>(.*?)</item>"), F.lit(1)))
    rows = feeds.select(id_col, atom.alias("atom"), F.posexplode(items).alias("n", "b"))

    def tag(name):
        data = F.regexp_extract("b", f"(?is)<{name}[^>]*><!\\[CDATA\\[(.*?)\\]\\]></{name}>", 1)
        return F.trim(F.when(data != "", data).otherwise(F.regexp_extract("b", f"(?is)<{name}[^>]*>(.*?)</{name}>", 1)))

    summary = F.when(tag("summary") != "", tag("summary")).otherwise(tag("content"))
    told = F.when(F.col("atom"), summary).otherwise(tag("description"))
    href = F.trim(F.regexp_extract("b", "(?is)<link[^>]*href[ \\t\\n]*=[ \\t\\n]*[\"']([^\"']*)[\"']", 1))
    link = F.when(F.col("atom") & (href != ""), href).otherwise(tag("link"))
    return rows.select(id_col, "n", tag("title").alias("title"), link.alias("link"), F.when(told.startswith("<"), strip_tags(told)).otherwise(told).alias("description"))


def safe_link(link: Column, base: Column) -> Column:
    """A link of a feed resolved against the feed's address; null unless it is http or https."""
    root = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    whole = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "/[^/]*$", "/"), link))
    return F.when(whole.rlike("^https?://[^/?#]+"), whole)


def feed_budget(items: DataFrame, most: int = 20, characters: int = 500_000, id_col: str = "page_id") -> DataFrame:
    """The first `most` items of each feed whose descriptions fit, one after the other, into the shared number of characters."""
    upto = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spent = items.withColumn("spent", F.sum(F.length("description")).over(upto)).withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy("n")))
    return spent.where((F.col("nth") <= most) & (F.col("spent") <= characters)).drop("spent", "nth")


def trust(verdict: Column) -> Column:
    """How a collected text is kept and shown."""
    kept = F.when(verdict == "allow", "stored").otherwise("quarantined")
    shown = F.when(verdict == "allow", "redacted").when(verdict == "warn", "spotlighted").otherwise("blocked")
    return F.struct(kept.alias("persistence"), shown.alias("display"))


def trust_rollup(items: DataFrame, id_col: str = "page_id") -> DataFrame:
    """items(id, verdict) -> (id, items, stored, persistence): stored, quarantined, partial, or skipped without items."""
    g = items.groupBy(id_col).agg(F.count("verdict").alias("items"), F.count_if(F.col("verdict") == "allow").alias("stored"))
    return g.withColumn("persistence", F.when(F.col("items") == 0, "skipped").when(F.col("stored") == F.col("items"), "stored").when(F.col("stored") == 0, "quarantined").otherwise("partial"))


def collect_pages(pages: DataFrame, rules=None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, title, domain, is_feed, verdict, persistence, display): pages as they enter the store. Titles are cut at 8,192
    characters, texts at 500,000; the stricter verdict of the text and of the seam of title and text counts. Without rules, all are used."""
    from tamis.functions.injection_rules import RULES
    from tamis.operators.injection import VERDICTS, content_findings, seams, verdicts

    base = page_titles(pages, id_col, html_col).join(page_text(pages, id_col, html_col), id_col).join(page_domains(pages, id_col, url_col), id_col).join(feeds(pages, id_col, html_col), id_col)
    base = base.withColumn("title", F.left("title", F.lit(8192))).withColumn("text", F.left("text", F.lit(500_000)))
    parts = base.select(F.struct(F.col(id_col), F.lit(0).alias("part")).alias("_k"), "text").unionByName(seams(base, "title", "text", id_col=id_col).select(F.struct(F.col(id_col), F.lit(1).alias("part")).alias("_k"), "text"))
    each = verdicts(parts, content_findings(parts, RULES if rules is None else rules, "_k", "text"), id_col="_k")
    names = F.array(*map(F.lit, VERDICTS))
    worst = each.groupBy(F.col(f"_k.{id_col}").alias("_p")).agg(F.get(names, F.max(F.array_position(names, F.col("verdict"))).cast("int") - 1).alias("verdict"))
    out = base.join(worst, F.col(id_col) == F.col("_p"))
    return out.select(id_col, "title", "domain", "is_feed", "verdict", trust(F.col("verdict")).alias("t")).select(id_col, "title", "domain", "is_feed", "verdict", "t.persistence", "t.display")


def markdown_text(c: Column) -> Column:
    """Text of Markdown: headings, emphasis (not inside words), links, images, fences, quotes and rules lose their marks."""
    c = F.regexp_replace(c, "(?m)^#{1,6}[ \\t]+", "")
    c = F.regexp_replace(c, "\\*{1,3}([^*]+)\\*{1,3}", "$1")
    c = F.regexp_replace(c, "(?<![A-Za-z0-9])_{1,3}([^_]+?)_{1,3}(?![A-Za-z0-9])", "$1")
    c = F.regexp_replace(c, "!\\[[^\\]]*\\]\\([^)]+\\)", "")
    c = F.regexp_replace(c, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    c = F.regexp_replace(c, "```[^\\n]*\\n([^`]*)```", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "`([^`]+)`", "$1"), "(?m)^>[ \\t]+", "")
    return F.trim(F.regexp_replace(c, "(?m)^[-*_]{3,}[ \\t]*$", ""))


def parse_documents(files: DataFrame, most: int = 500_000) -> DataFrame:
    """files(path, content) -> (path, kind, chunk_index, text, start_offset): Markdown and plain text, cut at `most`
    characters, in chunks; files of other kinds are left out."""
    kind = F.when(F.lower("path").rlike("\\.(md|markdown)$"), "markdown").when(F.lower("path").rlike("\\.(txt|text|log)$"), "text")
    rows = files.select("path", kind.alias("kind"), F.left("content", F.lit(most)).alias("c")).where("kind is not null")
    rows = rows.select("path", "kind", F.when(F.col("kind") == "markdown", markdown_text(F.col("c"))).otherwise(F.col("c")).alias("c"))
    return chunk_paragraphs(rows, id_col="path", text_col="c").join(rows.select(F.col("path").alias("_p"), "kind"), F.col("path") == F.col("_p")).select("path", "kind", "chunk_index", "text", "start_offset")


def feeds(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, is_feed): whether the body begins as an RSS or Atom document."""
    head = F.substring(F.regexp_replace(text_or_empty(html_col), "^[ \\t\\n\\r\\f]+", ""), 1, 1000)
    return pages.select(id_col, head.rlike("(?is)^(?:<\\?xml.*?\\?>[ \\t\\n\\r\\f]*)?<(?:rss|feed)(?![A-Za-z0-9_])").alias("is_feed"))


#: What the reference's \s and trim() take for blank, and the line ends of its ^ and $.
_BLANK, _LINE_END = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF", "\\n\\r\\u2028\\u2029"
#: A paragraph with such a line begins a section.
SECTION_BREAK = f"(?<![^{_LINE_END}])(?:#{{1,6}}[{_BLANK}]|[A-Z][A-Z{_BLANK}]{{5,}}(?![^{_LINE_END}])|[0-9]+\\.[{_BLANK}]+[A-Z]|={{3,}}(?![^{_LINE_END}])|-{{3,}}(?![^{_LINE_END}]))"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{_BLANK}]+|[{_BLANK}]+\\z", "")


def chunk_paragraphs(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, text, start_offset): paragraphs, split at blank lines, packed into chunks of about `size`
    characters; a longer paragraph is a chunk of its own, and a section heading begins a chunk. From the second on, a
    chunk begins with the last `overlap` characters of the one before if that is longer. Characters are code points
    (the reference counts those beyond U+FFFF twice)."""
    chunk = "struct<text:string,start:int>"
    kind = f"struct<done:array<{chunk}>,open:string,start:int,offset:int>"
    paragraphs = F.transform(F.split(text_or_empty(text_col), "\\n{2,}"), lambda p: F.struct(_trimmed(p).alias("p"), (F.length(p) + 2).alias("n")))
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("start"), F.lit(0).alias("offset")).cast(kind)

    def ended(acc):
        last = F.struct(_trimmed(acc["open"]).alias("text"), acc["start"].alias("start")).cast(chunk)
        return F.when(_trimmed(acc["open"]) == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))

    def pack(acc, x):
        p, opened = x["p"], acc["open"] != ""
        full = (p != "") & opened & ((F.length(acc["open"]) + F.length(p) > size) | p.rlike(SECTION_BREAK))
        carry = (F.length(acc["open"]) > overlap) if overlap > 0 else F.lit(False)
        carried = F.concat(F.right(acc["open"], F.lit(overlap)), F.lit("\n\n"), p)
        text = F.when(p == "", acc["open"]).when(full, F.when(carry, carried).otherwise(p)).when(opened, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p)
        begin = F.when(full & carry, acc["offset"] - overlap).when(full | ((p != "") & ~opened), acc["offset"]).otherwise(acc["start"])
        done = F.when(full, ended(acc)).otherwise(acc["done"])
        return F.struct(done.alias("done"), text.alias("open"), begin.alias("start"), (acc["offset"] + x["n"]).alias("offset")).cast(kind)

    chunks = docs.select(id_col, F.posexplode(F.aggregate(paragraphs, start, pack, ended)).alias("chunk_index", "_chunk"))
    return chunks.select(id_col, "chunk_index", F.col("_chunk.text").alias("text"), F.col("_chunk.start").alias("start_offset"))
