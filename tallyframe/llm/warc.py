"""Resolution of not-modified revisit records in web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Headers of a 304 answer that describe its own message and never replace those of the stored response.
OWN_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that say where a visitor came from.
TRACKING = "^(utm_[^=]*|gclid|fbclid)(=|$)"
URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """One form for the spellings of an address: http and https are one, the host is in lower case without
    user, ``www.`` and the port that its scheme has anyway, no slash ends the path, parameters are sorted,
    tracking and fragment go. Other strings stay as they are."""
    part = lambda i: F.regexp_extract(url, URL, i)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), "^.*@", "")
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":$")
    host = F.regexp_replace(F.regexp_replace(host, port, ""), "^www[.]", "")
    path = F.regexp_replace(part(3), "/+$", "")
    pairs = F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(url.rlike(URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(url)


def _agree(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def _tag(headers: str) -> Column:
    """The entity tag for weak comparison."""
    return F.regexp_replace(F.col(headers)["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, span: int = 86_400) -> DataFrame:
    """Answer each revisit record with the latest earlier full response of its canonical address.

    ``records`` has ``record_id``, ``url``, ``date`` (seconds), ``kind`` (``response`` or ``revisit``),
    ``status``, ``headers`` (a map with names in lower case) and ``payload_digest``; other columns are dropped.

    Returns one row for each revisit: ``record_id``, ``canonical_url``, ``refers_to``, ``outcome``, ``status``,
    ``headers`` and ``payload_digest``. The outcome is ``missing`` without an earlier response with status
    200, ``changed`` where entity tags (weak comparison), dates of change or payload digests that both have
    differ, ``unchecked`` where no validator is on both sides, else ``resolved``. A resolved or unchecked
    revisit has the response's status and digest, and its headers updated with the permitted ones of the
    revisit. Of responses at one address and time, the one with the largest record_id, then digest, then
    headers is taken; one at the revisit's own time is not earlier. Nulls in address or date give ``missing``;
    repeated revisits are answered each, repeated responses count once, and record ids need not be unique. An
    empty table gives an empty result.

    The as-of join works on the distinct times of each address, in spans: inside a span by a window over
    address and span, which holds at most ``span`` times, then the last response of earlier spans by a window
    over one row for each address and span. So an address with a large part of all records is not sorted in
    one task. Headers are joined by address and time at the end.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("date").cast("long").alias("date"), "kind", "status", "headers", "payload_digest")
    asks = rows.filter("kind = 'revisit'").select("record_id", "canonical_url", "date", F.col("status").alias("own_status"), F.col("headers").alias("own"), F.col("payload_digest").alias("own_digest"))
    full = rows.filter("kind = 'response' AND status = 200 AND canonical_url IS NOT NULL AND date IS NOT NULL")
    order = F.struct("record_id", "payload_digest", F.array_sort(F.map_entries("headers")))
    stored = full.groupBy("canonical_url", "date").agg(F.max_by(F.struct("record_id", "status", "headers", "payload_digest"), order).alias("_r"))
    stored = stored.select("canonical_url", F.col("date").alias("full_date"), F.col("_r.record_id").alias("refers_to"), F.col("_r.status").alias("old_status"), F.col("_r.headers").alias("old"), F.col("_r.payload_digest").alias("old_digest"))
    stored = written(stored, "responses")  # so that the join can split a response that many refer to

    times = stored.select("canonical_url", F.col("full_date").alias("date"), F.lit(True).alias("full"))
    times = times.unionByName(asks.filter("canonical_url IS NOT NULL AND date IS NOT NULL").select("canonical_url", "date", F.lit(False).alias("full")))
    times = times.groupBy("canonical_url", "date").agg(F.max("full").alias("full"), F.min("full").alias("sole"))
    times = times.select("canonical_url", "date", F.floor(F.col("date") / span).alias("span"), F.when(F.col("full"), F.col("date")).alias("here"), (~F.col("sole")).alias("asked"))
    earlier = W.partitionBy("canonical_url", "span").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    near = times.withColumn("near", F.max("here").over(earlier)).filter("asked")
    spans = times.groupBy("canonical_url", "span").agg(F.max("here").alias("last"))
    before = W.partitionBy("canonical_url").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("canonical_url", "span", F.max("last").over(before).alias("far")).filter("far IS NOT NULL")
    found = near.join(spans, ["canonical_url", "span"], "left")
    found = written(found.select("canonical_url", "date", F.coalesce("near", "far").alias("full_date")).filter("full_date IS NOT NULL"), "found")

    out = asks.join(found, ["canonical_url", "date"], "left").join(stored, ["canonical_url", "full_date"], "left")
    checks = F.array(_agree(_tag("own"), _tag("old")), _agree(F.col("own")["last-modified"], F.col("old")["last-modified"]), _agree(F.col("own_digest"), F.col("old_digest")))
    known = F.filter(checks, lambda c: c.isNotNull())
    outcome = F.when(F.col("full_date").isNull(), "missing").when(F.exists(known, lambda c: ~c), "changed").when(F.size(known) == 0, "unchecked").otherwise("resolved")
    permitted = F.map_filter("own", lambda k, _: ~k.isin(*OWN_HEADERS))
    kept = F.map_filter("old", lambda k, _: ~F.coalesce(F.map_contains_key(permitted, k), F.lit(False)))
    merged = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(permitted, F.create_map().cast("map<string,string>")))
    merges = F.col("outcome").isin("resolved", "unchecked")
    return out.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "refers_to",
        "outcome",
        F.when(merges, F.col("old_status")).otherwise(F.col("own_status")).alias("status"),
        F.when(merges, merged).otherwise(F.col("own")).alias("headers"),
        F.when(merges, F.col("old_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
    )
