"""Extraction from landed HTML pages: text, blocks, metadata, links, classes, names."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.batches import flat_map
from textmill.functions.text import col, last_wins, slug, strip
from textmill.operators.markup import area_of, without_tags
from textmill.operators.order import numbered
from textmill.sources.deltas import read_deltas, touched, write_delta
from textmill.sources.tables import remove, scratch_dir

#: Keywords that make a link relevant, and those of the document classes.
PRIORITY_WORDS = ("boja", "boe", "ley", "decreto", "orden", "resolucion", "normativa", "legislacion", "real decreto", "instruccion", "convenio", "disposicion")
TOPIC_WORDS = (
    "tea", "autismo", "discapacidad", "dependencia", "neae", "ayuda", "prestacion", "beca", "atencion", "temprana",
    "educativ", "familia", "guia", "tramite", "faq", "pregunta", "infantil", "especial", "valoracion", "orientacion",
)
SITES = ("juntadeandalucia", "boe.es")
CLASSES = (
    ("LEY", "01_leyes_y_normativa", ("boja", "boe", "ley", "decreto", "orden", "resolucion", "instruccion", "real decreto", "disposicion"), True),
    ("PROCEDIMIENTO", "02_procedimientos", ("tramite", "procedimiento", "solicitud", "reconocimiento", "valoracion"), True),
    ("ASOCIACION", "04_asociaciones", ("autismo", "mirame.org", "asociacion"), False),
    ("GUIA", "03_guias_y_recursos", (), True),
)
META_NAMES = ("description", "keywords", "dc.title", "dc.subject", "author")
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "div", "span", "strong", "em", "article", "section")
BOILERPLATE = ("script", "style", "nav", "footer", "header")


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def strip_boilerplate(html: str | Column, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    """The page without the subtrees of these tags, nested ones whole."""
    return without_tags(col(html), tags)


def unescape(text: str | Column) -> Column:
    """The five named entities of XML and the no-break space; & last."""
    out = col(text)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def page_title(html: str | Column) -> Column:
    return strip(unescape(F.regexp_extract(col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))


def page_meta(html: str | Column) -> Column:
    """Map of the known meta names; the later of two wins."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    attr = lambda x, a: F.regexp_extract(x, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    pairs = F.filter(F.transform(tags, lambda x: F.struct(F.lower(attr(x, "name")).alias("key"), unescape(attr(x, "content")).alias("value"))), lambda p: p["key"].isin(*META_NAMES))
    return last_wins(pairs)


def main_content(html: str | Column, url: str | Column) -> Column:
    """Gazette pages: the body. Others: the first main, else article, else content div, else the body, each with all
    that nests in it; an empty text where there is none."""
    gazette = F.coalesce(F.lower(col(url)).rlike("boja|boe[.]es"), F.lit(False))
    return area_of(col(html), gazette, "content|main|texto")


class _Blocks(HTMLParser):
    """Text of every block tag, ancestors included, in document order."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "source", "col", "area", "base", "embed", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.live: list[int] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.skip += tag in BOILERPLATE
        at = -1
        if tag in BLOCK_TAGS and not self.skip:
            at = len(self.found)
            self.found.append((tag, []))
            self.live.append(at)
        self.open.append((tag, at))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, at = self.open.pop()
            self.skip -= t in BOILERPLATE
            if at >= 0:
                self.live.remove(at)
            if t == tag:
                return

    def handle_data(self, data):
        if not self.skip and (data := data.strip()):
            for at in self.live:
                self.found[at][1].append(data)


def _blocks_of(html: str | None) -> Iterator[tuple[int, str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    last = None
    for pos, (tag, parts) in enumerate(parser.found):
        text = " ".join(parts)
        if len(text) > 3 and text != last:
            last = text
            yield pos, tag, text


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text): block texts over 3 characters, nested tags again, none equal to the one kept before.

    Only the parsing is Python (pieces of Arrow batches, row-local); boilerplate subtrees are skipped.
    """
    blocks = lambda page_id, html: ((page_id, *b) for b in _blocks_of(html))
    return flat_map(pages.select("page_id", "html"), blocks, "page_id long, pos int, tag string, text string")


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def page_links(pages: DataFrame, scope: str = "page") -> DataFrame:
    """(page_id, pos, href, text) of every a[href]. scope='content' reads pages without boilerplate."""
    html = F.col("html") if scope == "page" else strip_boilerplate("html")
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    links = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return links.select(
        "page_id",
        "url",
        "pos",
        unescape(F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("href"),
        strip(unescape(F.regexp_replace(F.regexp_replace("a", r"(?is)^<a\b[^>]*>|</a\s*>$", ""), r"<[^>]*>", ""))).alias("text"),
    )


def absolute_links(pages: DataFrame, scope: str = "page") -> DataFrame:
    """page_links with target: the address that href means on its page; null if it means none."""
    return page_links(pages, scope).withColumn("target", absolute_url("url", "href"))


def is_relevant(url: str | Column, text: str | Column, extra: tuple[str, ...] = ()) -> Column:
    words = any_of((*PRIORITY_WORDS, *TOPIC_WORDS, *extra))
    u, t = F.lower(col(url)), F.lower(F.coalesce(col(text), F.lit("")))
    return u.rlike(words) | t.rlike(words) | u.rlike(any_of(SITES)) | u.endswith(".pdf")


def split_links(links: DataFrame, visited: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Relevant links with kind PDF or HTML and default texts; HTML links in visited(url) are dropped."""
    pdf = F.lower("target").endswith(".pdf")
    out = links.where(is_relevant("target", "text", extra)).withColumn("kind", F.when(pdf, "PDF").otherwise("HTML"))
    out = out.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.when(pdf, "Documento PDF").otherwise("Enlace relacionado")))
    if visited is not None:
        seen = visited.select(F.col("url").alias("__seen")).distinct()
        out = out.join(seen, (F.col("target") == F.col("__seen")) & (F.col("kind") == "HTML"), "left_anti")
    return out


def cap_links(links: DataFrame) -> DataFrame:
    """The first links of each page by kind: PDF 20, HTML 10 on legislative pages, else 5 and 3."""
    law = F.lower("url").rlike("ley|decreto|orden|resolucion")
    cap = F.when(F.col("kind") == "PDF", F.when(law, 20).otherwise(5)).otherwise(F.when(law, 10).otherwise(3))
    rank = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("pos"))
    return links.withColumn("rank", rank).where(F.col("rank") <= cap)


def canonical_address(url: str | Column) -> Column:
    """host/path?query of a web address: host in lower case without www. and a default port, no tracking
    parameters, slashes at the path's end or fragment. Other addresses stay as they are."""
    u = F.regexp_replace(col(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^(?i)https?://([^/?]+)", 1)), "^www[.]|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^(?i)https?://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "^[^?]*[?](.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(?i)(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""), "^&", "")
    return F.when(host == "", col(url)).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def start_depth(url: str | Column) -> Column:
    return F.when(F.lower(col(url)).rlike("boja|ley|decreto|orden"), 2).otherwise(1)


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_depth: int = 2) -> DataFrame:
    """(url, depth) reached from seeds(url, depth) over links(url, target, kind): least depth wins; PDF
    targets keep the depth of their page, others are one deeper; pages at max_depth aren't expanded.

    Each round follows the pages that are new or were reached at less depth, until there are none. A round adds
    these as a delta in hash buckets; of what was visited before it reads the buckets of its targets only."""
    spark = seeds.sparkSession
    visited, hops_at = scratch_dir(spark, "visited"), scratch_dir(spark, "hops")
    links.select("url", "target", "kind").distinct().write.parquet(hops_at)
    hops = spark.read.parquet(hops_at)
    first = seeds.groupBy("url").agg(F.min("depth").alias("depth"))
    schema, batch = first.schema, 0
    write_delta(first, visited, ["url"], batch)
    while True:
        frontier = read_deltas(spark, visited, schema).where(F.col("d_batch") == batch)
        step = frontier.where(F.col("depth") < max_depth).join(hops, "url")
        reached = step.select(F.col("target").alias("url"), (F.col("depth") + F.when(F.col("kind") == "PDF", 0).otherwise(1)).cast(schema["depth"].dataType).alias("depth"))
        path = scratch_dir(spark, "reached")
        reached.groupBy("url").agg(F.min("depth").alias("depth")).write.parquet(path)
        reached = spark.read.schema(schema).parquet(path)
        had = read_deltas(spark, visited, schema, touched(reached, ["url"])).groupBy("url").agg(F.min("depth").alias("had"))
        new = reached.join(had, "url", "left").where("had IS NULL OR depth < had").select("url", "depth")
        write_delta(new, visited, ["url"], batch + 1)
        remove(spark, path)
        if read_deltas(spark, visited, schema).where(F.col("d_batch") == batch + 1).isEmpty():
            remove(spark, hops_at)
            return read_deltas(spark, visited, schema).groupBy("url").agg(F.min("depth").alias("depth"))
        batch += 1


def classify(url: str | Column, title: str | Column) -> Column:
    """struct<category, directory> by the first rule that holds; ASOCIACION looks at the URL only."""
    u, t = F.lower(col(url)), F.lower(F.coalesce(col(title), F.lit("")))
    out = None
    for name, folder, words, titles in CLASSES[:-1]:
        hit = u.rlike(any_of(words))
        hit = hit | t.rlike(any_of(words)) if titles else hit
        value = F.struct(F.lit(name).alias("category"), F.lit(folder).alias("directory"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit(CLASSES[-1][0]).alias("category"), F.lit(CLASSES[-1][1]).alias("directory")))


def doc_priority(url: str | Column) -> Column:
    return F.when(F.lower(col(url)).rlike("boja|boe[.]es|ley|decreto|orden|resolucion"), "ALTA").otherwise("MEDIA")


def doc_type(url: str | Column) -> Column:
    return F.when(F.lower(col(url)).endswith(".pdf"), "PDF").otherwise("HTML")


def page_name(title: str | Column, url: str | Column) -> Column:
    """The title's slug; of the URL's last path segment where the title gives none."""
    first = slug(title)
    segment = F.element_at(F.split(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "/"), -1)
    return F.when(first == "documento", slug(segment)).otherwise(first)


def unique_names(docs: DataFrame, group: str = "category", name: str = "name", order: str = "page_id") -> DataFrame:
    """Adds file: name.txt, or name_1.txt, name_2.txt ... for later ones of a group."""
    n = F.col("__n") - 1
    file = F.concat(name, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".txt"))
    return numbered(docs, [order], "__n", (group, name)).withColumn("file", file).drop("__n")


def render_document(category, kind, title, url, content) -> Column:
    rule = F.lit("=" * 80)
    field = lambda n, v: F.concat(F.lit(f"{n}: "), F.coalesce(col(v), F.lit("")))
    return F.concat_ws("\n", rule, field("CATEGORÍA", category), field("TIPO", kind), field("TÍTULO", title), field("URL ORIGINAL", url), rule, F.lit(""), F.coalesce(col(content), F.lit("")))


def extraction_errors(docs: DataFrame) -> DataFrame:
    """(cause, n): failed extractions by HTTP status; other causes are empty."""
    failed = docs.where(F.col("text").startswith("ERROR: No se pudo"))
    return failed.groupBy(F.regexp_extract("text", r"Error: (\d{3})", 1).alias("cause")).agg(F.count("*").alias("n"))


def extraction_summary(docs: DataFrame) -> DataFrame:
    """(type, priority, category, n_docs, n_urls): totals and counts by each in one pass."""
    by = ["type", "priority", "category"]
    return docs.groupingSets([[c] for c in by] + [[]], *by).agg(F.count("*").alias("n_docs"), F.countDistinct("url").alias("n_urls"))


def document_index(docs: DataFrame) -> DataFrame:
    """Documents numbered within their category."""
    return numbered(docs, ["page_id"], "number", ("category",))
