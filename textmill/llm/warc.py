"""WARC captures: not-modified revisits resolved by an as-of join.

A revisit (a 304 answer without payload) is resolved to the latest earlier full response with the same
canonical URL. Its validators must fit the response's; the headers that a 304 may change replace the
stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import let

#: Header fields of a 304 that never replace stored ones (hop-by-hop fields and those that describe
#: the stored payload; RFC 9111, sections 3.1 and 3.2). Fixed values.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that only track a visit.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"
#: Slices of time into which a URL's captures are cut, so that no window holds all of a hot URL's.
SLICES = 128


def canonical_url(url: str | Column) -> Column:
    """Host in lower case without www. and default port, path without closing slash, query without
    tracking parameters, no scheme, no fragment. Null and texts that are no http URL: null."""
    url = F.col(url) if isinstance(url, str) else url
    shape = r"(?i)^\s*https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)(:[0-9]+)?([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.regexp_extract(url, shape, i)
    port = F.when(part(2).isin(":80", ":443"), "").otherwise(part(2))
    path = F.regexp_replace(part(3), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(part(4), f"(?i)(^|&){TRACKING}", ""), "^&", "")
    out = F.concat(F.lower(part(1)), port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNotNull() & (part(1) != ""), out)


def header_fields(block: str | Column) -> Column:
    """array<struct<name, value>> of a block of header lines: names in lower case and order, repeated
    fields joined by a comma. Lines without a colon are skipped; null is an empty array."""
    block = F.col(block) if isinstance(block, str) else block
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    names = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda p: p["name"])))
    values = lambda a, n: F.transform(F.filter(a, lambda p: p["name"] == n), lambda p: p["value"])
    return let(pairs, lambda a: F.transform(names(a), lambda n: F.struct(n.alias("name"), F.concat_ws(", ", values(a, n)).alias("value"))))


def field(fields: str, name: str) -> Column:
    """The value of one header field; null if there is none."""
    return F.try_element_at(F.filter(F.col(fields), lambda p: p["name"] == name), F.lit(1))["value"]


def merged_fields(stored: str, fresh: str) -> Column:
    """Header lines of the stored response with the permitted fields of the 304 in their place."""
    allowed = F.filter(F.col(fresh), lambda p: ~p["name"].isin(*NOT_MERGED))
    both = let(allowed, lambda a: let(F.transform(a, lambda p: p["name"]), lambda names: F.array_sort(F.concat(F.filter(F.col(stored), lambda p: ~F.array_contains(names, p["name"])), a))))
    return F.array_join(F.transform(both, lambda p: F.concat_ws(": ", p["name"], p["value"])), "\n")


def last_before(rows: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """rows with `found`: the last non-null `value` of the same key before the row, by (ts, tie).

    Two levels: inside slices of time (quantiles of ts over all rows), then over one row for each
    key and slice. So a key with a third of all rows is spread over SLICES tasks.
    """
    bounds = rows.agg(F.percentile_approx(ts, F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), F.lit(10_000)).alias("__bounds"))  # one row
    cut = rows.join(F.broadcast(bounds))
    cut = cut.withColumn("__slice", F.size(F.filter(F.coalesce("__bounds", F.array().cast("array<long>")), lambda b: b <= F.col(ts)))).drop("__bounds")
    inside = Window.partitionBy(key, "__slice").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__near", F.last(value, ignorenulls=True).over(inside))
    ends = cut.where(F.col(value).isNotNull()).groupBy(key, "__slice").agg(F.max(F.struct(ts, tie, value))[value].alias("__end"))
    spots = cut.select(key, "__slice").distinct().join(ends, [key, "__slice"], "left")
    over = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(key, "__slice", F.last("__end", ignorenulls=True).over(over).alias("__carried"))
    out = cut.join(carried, [key, "__slice"], "left")
    return out.withColumn("found", F.coalesce("__near", "__carried")).drop("__near", "__carried", "__slice")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, refers_to, state, payload_digest, headers) for every revisit in records.

    records(record_id, type, url, ts, status, headers, payload_digest): type is response or revisit,
    ts a timestamp as long, headers a block of lines. Full responses are those with status 200 and a
    payload digest. state is resolved (an ETag, weak comparison, or else Last-Modified is equal),
    mismatch (they differ), unverified (the revisit names none that the response has; its payload
    digest, if any, must then be equal) or orphan (no earlier full response, or no URL). Only resolved
    and unverified revisits get a payload digest and merged headers; the others keep their own
    headers. Equal times go by record_id; a null ts comes before all others.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.lower("type").alias("type"),
        canonical_url(F.col("url").cast("string")).alias("url_key"),
        F.coalesce(F.col("ts").cast("long"), F.lit(-(1 << 62))).alias("ts"),
        F.col("status").cast("int").alias("status"),
        header_fields(F.col("headers").cast("string")).alias("fields"),
        F.col("payload_digest").cast("string").alias("digest"),
    )
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()
    rows = rows.where(full | (F.col("type") == "revisit"))
    rows = rows.withColumn("full", F.when(full, F.struct("record_id", "digest", "fields")))
    keyed = last_before(rows.where("url_key IS NOT NULL"), "url_key", "ts", "record_id", "full")
    lost = rows.where("url_key IS NULL").withColumn("found", F.lit(None).cast(rows.schema["full"].dataType))
    seen = keyed.unionByName(lost).where("type = 'revisit'").withColumn("old", F.col("found.fields"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tag, old_tag = field("fields", "etag"), field("old", "etag")
    since, old_since = field("fields", "last-modified"), field("old", "last-modified")
    state = (
        F.when(F.col("found").isNull(), "orphan")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(weak(tag) == weak(old_tag), "resolved").otherwise("mismatch"))
        .when(since.isNotNull() & old_since.isNotNull(), F.when(since == old_since, "resolved").otherwise("mismatch"))
        .when(F.col("digest").isNotNull() & (F.col("digest") != F.col("found.digest")), "mismatch")
        .otherwise("unverified")
    )
    seen = seen.withColumn("state", state)
    used = F.col("state").isin("resolved", "unverified")
    own = F.array_join(F.transform("fields", lambda p: F.concat_ws(": ", p["name"], p["value"])), "\n")
    return seen.select(
        "record_id",
        "url_key",
        F.col("found.record_id").alias("refers_to"),
        "state",
        F.when(used, F.col("found.digest")).alias("payload_digest"),
        F.when(used, merged_fields("old", "fields")).otherwise(own).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made of pages(page_id, url, html): each page as a full response, and a
    not-modified revisit half an hour before and after it. By page_id, the revisits carry the
    page's ETag, a weak one, another one, only Last-Modified, or no validator."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    page = page.select("page_id", "url", F.md5("html").alias("digest"), F.length("html").alias("n"))
    at = F.col("page_id") * 3600
    which = F.col("page_id") % 5
    tag = F.concat(F.lit('"'), "digest", F.lit('"'))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    full = F.concat_ws("\r\n", F.lit("Content-Type: text/html; charset=utf-8"), line("Content-Length", F.col("n")), line("Date", at), line("ETag", tag), line("Last-Modified", at))

    def revisit(ts):
        validator = F.when(which == 0, line("ETag", F.lit('"other"'))).when(which == 1, line("ETag", F.concat(F.lit("W/"), tag))).when(which == 2, line("Last-Modified", at)).when(which == 3, line("ETag", tag))
        return F.concat_ws("\r\n", line("Date", ts), line("Cache-Control", F.concat(F.lit("max-age="), (F.col("page_id") % 7).cast("string"))), F.lit("Content-Length: 0"), F.lit("Connection: close"), validator)

    def record(number, kind, ts, status, headers, digest):
        return F.struct((F.col("page_id") * 3 + number).alias("record_id"), F.lit(kind).alias("type"), "url", ts.alias("ts"), F.lit(status).alias("status"), headers.alias("headers"), digest.alias("payload_digest"))

    none = F.lit(None).cast("string")
    made = F.array(
        record(0, "response", at, 200, full, F.col("digest")),
        record(1, "revisit", at + 1800, 304, revisit(at + 1800), none),
        record(2, "revisit", at - 1800, 304, revisit(at - 1800), none),
    )
    return page.select(F.explode(made).alias("r")).select("r.*")
