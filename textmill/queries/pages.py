"""Queries on landed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as t
from textmill.operators import html as h
from textmill.queries.register import registry
from textmill.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: The pages at hand are invented, so some of their syllables stand in for the keywords.
EXTRA_WORDS = ("th", "aux")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{t.BLANK}+|{t.BLANK}+$', '', 'g')"


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    return x


_TITLE = _strip(_unescape(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))
#: Pages as they come, and with nested elements put around and into their article: the same change in SQL.
_NESTED = (
    (1, (("<article>", "<article><div class='ad'>x</div><article class=a>first <div>in</div></article>"),)),
    (2, (("<article>", "<div class='page main'><div>a</div><div id=\"t>\"><div>b</div></div>"), ("</article>", "</div>"))),
    (3, (("<article>", "<main id=m><nav><div><nav>x</nav></div>y</nav><header><header></header>z</header><article>"), ("</article>", "</article><div>end</div></main>"))),
)


def _nested_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = "CASE page_id % 4"
    for n, changes in _NESTED:
        x = "html"
        for a, b in changes:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        out += f" WHEN {n} THEN {x}"
    return out + " ELSE html END"


def nested_pages(pages):
    """(page_id, url, html) with one of the nestings on three pages of four."""
    out = None
    for n, changes in _NESTED:
        x = F.col("html")
        for a, b in changes:
            x = F.replace(x, F.lit(a), F.lit(b))
        out = F.when(F.col("page_id") % 4 == n, x) if out is None else out.when(F.col("page_id") % 4 == n, x)
    return pages.select("page_id", "url", out.otherwise(F.col("html")).alias("html"))


#: SQL counts depth by a running sum over the tags, piece by piece.
_SCRIPTS = r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_DROPPED = rf"(?is){_SCRIPTS}|</?(?:nav|footer|header)\b[^>]*>"
_STRIPPED = rf"""
    nested AS (SELECT page_id, url, {_nested_sql()} AS html FROM pages),
    cut AS (SELECT page_id, url, string_split_regex(html, '{_DROPPED}') AS pieces, list_prepend('', regexp_extract_all(html, '{_DROPPED}')) AS tags FROM nested),
    parts AS (SELECT page_id, url, i, pieces[i] AS piece, sum(CASE WHEN regexp_matches(tags[i], '(?i)^</(nav|footer|header)') THEN -1 WHEN regexp_matches(tags[i], '(?i)^<(nav|footer|header)') THEN 1 ELSE 0 END)
        OVER (PARTITION BY page_id ORDER BY i) AS depth FROM cut, unnest(range(1, len(pieces) + 1)) u(i)),
    bare AS (SELECT page_id, url, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE depth = 0), '') AS html FROM parts GROUP BY ALL)"""
_WORDS = ("th", "aux")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{t.BLANK}+|{t.BLANK}+$', '', 'g')"


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    return x


_TITLE = _strip(_unescape(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))
_BARE = "html"
for _t in h.BOILERPLATE:
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_t}\b[^>]*>.*?</{_t}\s*>', '', 'g')"
_WORDS = h.any_of((*h.PRIORITY_WORDS, *h.TOPIC_WORDS, *EXTRA_WORDS))
_LINKS = rf"""
    found AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a\s*>') AS l FROM pages),
    tags AS (SELECT page_id, url, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS a FROM found),
    links AS (SELECT page_id, url, pos, {_unescape(r"regexp_extract(a, '(?is)\bhref\s*=\s*[" + chr(34) + r"'']([^" + chr(34) + r"'']*)[" + chr(34) + r"'']', 1)")} AS href,
        {_strip(_unescape(r"regexp_replace(regexp_replace(a, '(?is)^<a\b[^>]*>|</a\s*>$', '', 'g'), '<[^>]*>', '', 'g')"))} AS text FROM tags)"""
_RELEVANT = f"(regexp_matches(lower(href), '{_WORDS}') OR regexp_matches(lower(text), '{_WORDS}') OR regexp_matches(lower(href), '{h.any_of(h.SITES)}') OR lower(href) LIKE '%.pdf')"
_CAPS = f"""WITH {_LINKS},
    kinds AS (SELECT page_id, url, pos, href AS target, CASE WHEN text = '' THEN CASE WHEN lower(href) LIKE '%.pdf' THEN 'Documento PDF' ELSE 'Enlace relacionado' END ELSE text END AS text,
        CASE WHEN lower(href) LIKE '%.pdf' THEN 'PDF' ELSE 'HTML' END AS kind FROM links WHERE {_RELEVANT}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY pos) AS rank FROM kinds),
    capped AS (SELECT * FROM ranked WHERE rank <= CASE WHEN regexp_matches(lower(url), 'ley|decreto|orden|resolucion') THEN CASE kind WHEN 'PDF' THEN 20 ELSE 10 END ELSE CASE kind WHEN 'PDF' THEN 5 ELSE 3 END END)"""


def _class_sql(i: int) -> str:
    out = "CASE"
    for c in h.CLASSES[:-1]:
        words = h.any_of(c[2])
        hit = f"regexp_matches(lower(url), '{words}')" + (f" OR regexp_matches(lower(title), '{words}')" if c[3] else "")
        out += f" WHEN {hit} THEN '{c[i]}'"
    return out + f" ELSE '{h.CLASSES[-1][i]}' END"


_FROM, _TO = "".join(c for c, _ in t.FOLD), "".join(a for _, a in t.FOLD)


def _slug(x: str) -> str:
    out = f"""regexp_replace({x}, '[<>:"/\\\\|?*]', '', 'g')"""
    out = rf"regexp_replace(translate({out}, '{_FROM}', '{_TO}'), '[^\x00-\x7F]', '', 'g')"
    out = rf"regexp_replace({out}, '[\x09-\x0D\x20-]+', '_', 'g')"
    out = f"regexp_replace(substr(translate({out}, '.,', ''), 1, 150), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN coalesce({out}, '') = '' THEN 'documento' ELSE {out} END)"


_SEGMENT = r"regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1)"
_DOCS = f"""
    titled AS (SELECT page_id, url, {_TITLE} AS title FROM pages),
    slugs AS (SELECT *, {_slug('title')} AS s1, {_slug(_SEGMENT)} AS s2 FROM titled),
    docs AS (SELECT page_id, url, title, {_class_sql(0)} AS category, {_class_sql(1)} AS directory,
        CASE WHEN regexp_matches(lower(url), 'boja|boe[.]es|ley|decreto|orden|resolucion') THEN 'ALTA' ELSE 'MEDIA' END AS priority,
        CASE WHEN lower(url) LIKE '%.pdf' THEN 'PDF' ELSE 'HTML' END AS type,
        CASE WHEN s1 = 'documento' THEN s2 ELSE s1 END AS name FROM slugs)"""


def documents_of(pages):
    """(page_id, url, title, category, directory, priority, type, name) of every page."""
    titled = pages.select("page_id", "url", h.page_title("html").alias("title"))
    c = h.classify("url", "title")
    return titled.select("page_id", "url", "title", c["category"].alias("category"), c["directory"].alias("directory"), h.doc_priority("url").alias("priority"), h.doc_type("url").alias("type"), h.page_name("title", "url").alias("name"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", h.page_title("html").alias("title"))


@query(f"WITH {_STRIPPED} SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM bare")
def page_text(spark, sf_dir):
    """Most pages get nested elements first."""
    pages = nested_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", F.regexp_replace(h.strip_boilerplate("html"), "<[^>]*>", " ").alias("text"))


@query(f"WITH {_LINKS} SELECT * FROM links")
def page_links(spark, sf_dir):
    return h.page_links(table(spark, sf_dir, "pages"))


@query(f"{_CAPS} SELECT * FROM capped")
def link_caps(spark, sf_dir):
    links = h.page_links(table(spark, sf_dir, "pages")).withColumnRenamed("href", "target")
    return h.cap_links(h.split_links(links, extra=EXTRA_WORDS)).select("page_id", "url", "pos", "target", "text", "kind", "rank")


@query(f"""{_CAPS} SELECT page_id, pos, target, kind FROM kinds WHERE kind = 'PDF' OR length(target) % 2 = 1""")
def unvisited_links(spark, sf_dir):
    """Relevant links when every address of even length was visited; PDF links are followed again."""
    links = h.page_links(table(spark, sf_dir, "pages")).withColumnRenamed("href", "target")
    visited = links.where(F.length("target") % 2 == 0).select(F.col("target").alias("url"))
    return h.split_links(links, visited, EXTRA_WORDS).select("page_id", "pos", "target", "kind")


@query(f"WITH {_DOCS} SELECT page_id, category, directory FROM docs")
def page_classes(spark, sf_dir):
    return documents_of(table(spark, sf_dir, "pages")).select("page_id", "category", "directory")


@query(f"WITH {_DOCS} SELECT page_id, priority, type, CASE WHEN regexp_matches(lower(url), 'boja|ley|decreto|orden') THEN 2 ELSE 1 END AS depth FROM docs")
def page_priority(spark, sf_dir):
    return documents_of(table(spark, sf_dir, "pages")).select("page_id", "priority", "type", h.start_depth("url").alias("depth"))


@query(f"WITH {_DOCS} SELECT page_id, name FROM docs")
def page_slugs(spark, sf_dir):
    return documents_of(table(spark, sf_dir, "pages")).select("page_id", "name")


@query(f"""WITH {_DOCS}, n AS (SELECT page_id, category, name, row_number() OVER (PARTITION BY category, name ORDER BY page_id) - 1 AS k FROM docs)
    SELECT page_id, category, name, name || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.txt' AS file FROM n""")
def unique_names(spark, sf_dir):
    return h.unique_names(documents_of(table(spark, sf_dir, "pages")).select("page_id", "category", "name"))


@query(f"""WITH {_DOCS}, n AS (SELECT page_id, priority, type, row_number() OVER (PARTITION BY priority, type ORDER BY page_id) - 1 AS k FROM docs)
    SELECT page_id, priority AS category, type AS name, type || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.txt' AS file FROM n""")
def repeated_names(spark, sf_dir):
    """Types as names, so that almost every name is taken already."""
    docs = documents_of(table(spark, sf_dir, "pages")).select("page_id", F.col("priority").alias("category"), F.col("type").alias("name"))
    return h.unique_names(docs)


@query(f"WITH {_DOCS} SELECT type, priority, category, count(*) AS n_docs, count(DISTINCT url) AS n_urls FROM docs GROUP BY GROUPING SETS ((type), (priority), (category), ())")
def extraction_summary(spark, sf_dir):
    return h.extraction_summary(documents_of(table(spark, sf_dir, "pages")))


@query(f"WITH {_DOCS} SELECT page_id, category, title, row_number() OVER (PARTITION BY category ORDER BY page_id) AS number FROM docs")
def document_index(spark, sf_dir):
    return h.document_index(documents_of(table(spark, sf_dir, "pages")).select("page_id", "category", "title"))


_PIECES = f"""pieces AS (SELECT doc_id, 1 AS pos, 'h1' AS tag, coalesce(source, '') AS text FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 1 + generate_subscripts(l, 1), 'li', {_strip('unnest(l)')} FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(f"""WITH {_PIECES}, blocks AS (SELECT * FROM pieces
        UNION ALL SELECT doc_id, 0, 'article', string_agg(text, ' ' ORDER BY pos) FROM pieces WHERE text <> '' GROUP BY 1),
    marked AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM blocks WHERE length(text) > 3)
    SELECT doc_id AS page_id, CAST(pos AS INT) AS pos, tag, sha256(text) AS text FROM marked WHERE before IS NULL OR before <> text""")
def nested_blocks(spark, sf_dir):
    """Documents as pages: a menu, which isn't read, then an article of a heading and a list of the lines."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<li>"), escape(x), F.lit("</li>"))), "")
    page = F.concat(F.lit("<nav><ul><li>read no menu</li></ul></nav><article><h1>"), escape(F.coalesce("source", F.lit(""))), F.lit("</h1><ul>"), items, F.lit("</ul></article>"))
    made = h.page_blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html")))
    return made.withColumn("text", F.sha2("text", 256))


@query()
def page_blocks(spark, sf_dir):
    return h.page_blocks(table(spark, sf_dir, "pages"))


@query(f"""SELECT page_id, coalesce(len(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')), 0) + 3 AS n_meta, 'page ' || page_id AS description, 'a & b' AS keywords, CAST(NULL AS VARCHAR) AS author, {_TITLE} AS title FROM pages""")
def page_meta(spark, sf_dir):
    """The given pages have no known meta tags, so each gets some: twice the same name, one with an entity."""
    tags = F.concat(F.lit("<meta name='description' content='first'><meta content='a &amp; b' name=\"keywords\"><meta name=\"description\" content=\"page "), F.col("page_id").cast("string"), F.lit('">'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(tags, "html").alias("html"))
    known = h.page_meta("html")
    field = lambda name: F.try_element_at(known, F.lit(name)).alias(name)
    return pages.select("page_id", F.regexp_count("html", F.lit(r"(?is)<meta\b[^>]*>")).alias("n_meta"), field("description"), field("keywords"), field("author"), h.page_title("html").alias("title"))


@query(f"""WITH {_LINKS} SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href ELSE href END AS target FROM links""")
def absolute_links(spark, sf_dir):
    """The given links all begin with a slash."""
    return h.absolute_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "target")


@query(f"""WITH {_LINKS}, parts AS (SELECT page_id, pos, href, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS site, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*/)', 1) AS folder FROM links)
    SELECT page_id, pos, CASE WHEN href NOT LIKE '/%' THEN href ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || substr(href, 2) END AS target FROM parts""")
def relative_links(spark, sf_dir):
    """The given links without their first slash: they mean an address beside their page's."""
    links = h.page_links(table(spark, sf_dir, "pages")).withColumn("href", F.regexp_replace("href", "^/", ""))
    return links.select("page_id", "pos", h.absolute_url("url", "href").alias("target"))


@query("""SELECT CASE WHEN page_id % 5 = 0 THEN '' ELSE CAST(400 + page_id % 5 AS VARCHAR) END AS cause, count(*) AS n FROM pages WHERE page_id % 7 <> 0 GROUP BY 1""")
def extraction_errors(spark, sf_dir):
    """What the extractor would have stored had most pages failed."""
    i = F.col("page_id")
    cause = F.when(i % 5 == 0, "timed out").otherwise(F.concat((400 + i % 5).cast("string"), F.lit(" Client Error")))
    failed = F.concat(F.lit("ERROR: No se pudo extraer "), "url", F.lit("\nError: "), cause)
    return h.extraction_errors(table(spark, sf_dir, "pages").select(F.when(i % 7 == 0, F.col("html")).otherwise(failed).alias("text")))


@query(rf"""WITH {_STRIPPED},
    named AS (SELECT page_id, html, CASE WHEN regexp_matches(html, '(?i)<main\b') THEN 'main' WHEN regexp_matches(html, '(?i)<article\b') THEN 'article' ELSE 'div' END AS tag FROM bare),
    split AS (SELECT page_id, tag, CASE tag WHEN 'main' THEN string_split_regex(html, '(?i)</?main\b[^>]*>') WHEN 'article' THEN string_split_regex(html, '(?i)</?article\b[^>]*>') ELSE string_split_regex(html, '(?i)</?div\b(?:[^>"]|"[^"]*")*>') END AS pieces,
        CASE tag WHEN 'main' THEN regexp_extract_all(html, '(?i)</?main\b[^>]*>') WHEN 'article' THEN regexp_extract_all(html, '(?i)</?article\b[^>]*>') ELSE regexp_extract_all(html, '(?i)</?div\b(?:[^>"]|"[^"]*")*>') END AS tags FROM named),
    each AS (SELECT page_id, tag, i, tags[i] AS t, pieces[i + 1] AS piece FROM split, unnest(range(1, len(tags) + 1)) u(i)),
    first AS (SELECT page_id, min(i) AS k FROM each WHERE t NOT LIKE '</%' AND (tag <> 'div' OR regexp_matches(t, 'class=.[^"'']*(content|main|texto)')) GROUP BY 1),
    deep AS (SELECT e.*, k, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM each e JOIN first USING (page_id) WHERE i >= k),
    ends AS (SELECT page_id, min(i) AS e FROM deep WHERE depth = 0 GROUP BY 1),
    content AS (SELECT page_id, string_agg(CASE WHEN i = k THEN piece ELSE t || piece END, '' ORDER BY i) AS html FROM deep JOIN ends USING (page_id) WHERE i < e GROUP BY 1)
    SELECT page_id, length(html) AS n, md5(html) AS digest FROM content""")
def content_length(spark, sf_dir):
    """The main content of pages with nested elements, boilerplate taken out before."""
    pages = nested_pages(table(spark, sf_dir, "pages"))
    bare = pages.select("page_id", "url", h.strip_boilerplate("html").alias("html"))
    content = bare.select("page_id", h.main_content("html", "url").alias("content"))
    return content.select("page_id", F.length("content").alias("n"), F.md5("content").alias("digest"))


def _canonical(x: str) -> str:
    u = f"regexp_replace({x}, '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/?]+)', 1)), '^www[.]|:(?:80|443)$', '', 'g')"
    path = f"regexp_replace(regexp_extract({u}, '(?i)^https?://[^/?]+([^?]*)', 1), '/+$', '')"
    query = f"regexp_replace(regexp_replace(regexp_extract({u}, '^[^?]*[?](.*)$', 1), '(?i)(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '')"
    return f"(CASE WHEN {host} = '' THEN {x} ELSE {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END)"


_PAGE_FRONTIER = f"""{_CAPS.replace("WITH", "WITH RECURSIVE", 1)},
    whole AS (SELECT url, kind, CASE WHEN target LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || target ELSE target END AS target FROM capped),
    hops AS (SELECT DISTINCT {_canonical("url")} AS url, {_canonical("target")} AS target, kind FROM whole),
    walk AS (SELECT {_canonical("url")} AS url, 0 AS depth FROM pages UNION SELECT h.target, w.depth + CASE h.kind WHEN 'PDF' THEN 0 ELSE 1 END FROM walk w JOIN hops h ON h.url = w.url WHERE w.depth < 2)
    SELECT url, min(depth) AS depth FROM walk GROUP BY 1"""


@query(_PAGE_FRONTIER)
def crawl_frontier_pages(spark, sf_dir):
    """From every page over its capped links, by canonical address. The given links all begin with a slash."""
    pages = table(spark, sf_dir, "pages")
    links = h.cap_links(h.split_links(h.page_links(pages).withColumnRenamed("href", "target"), extra=EXTRA_WORDS))
    hops = links.select(h.canonical_address("url").alias("url"), h.canonical_address(h.absolute_url("url", "target")).alias("target"), "kind")
    return h.crawl_frontier(pages.select(h.canonical_address("url").alias("url"), F.lit(0).alias("depth")), hops)


@query(_PAGE_FRONTIER)
def crawl_frontier(spark, sf_dir):
    return crawl_frontier_pages(spark, sf_dir)
