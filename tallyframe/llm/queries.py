"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from .align import alignment
from .common import held_out, lower_ascii, table
from .exact_dedup import exact_dedup
from .fertility import quality_rules
from .html_text import extract
from .line_dedup import line_dedup
from .merkle import fold, leaf_digest, manifest
from .near_dup import near_duplicates
from .packing import pack_documents
from .tokens import token_digests
from .topk import top_k
from .warc import resolve_revisits

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def web_records(pages: DataFrame) -> DataFrame:
    """Archive records about ``pages``, ten for each nine pages or so; every third page is at one hot address.

    The last digit of the id decides: 7 has no response at all, 3 a failed one and an older full one, 8 an older
    full one too, 1 and 5 a later one that a revisit must not see. Revisits of 2 have another entity tag, those
    of 4 none but a date of change, those of 6 no validator.
    """
    digit = F.col("page_id") % 10
    pages = pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, "http://hot.example.com/").otherwise(F.col("url")))
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))

    def response(rows: DataFrame, number: int, seconds: int, status: int, mark: str) -> DataFrame:
        common = F.create_map(*map(F.lit, ("content-type", "text/html", "cache-control", "max-age=60")), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), F.concat(F.lit(mark), tag), F.lit("last-modified"), (F.col("page_id") * 7).cast("string"))
        return rows.select(
            (4 * F.col("page_id") + number).alias("record_id"),
            "url",
            (F.col("page_id") * 1000 + seconds).alias("date"),
            F.lit("response").alias("kind"),
            F.lit(status).alias("status"),
            common.alias("headers"),
            F.sha2(F.concat("html", F.lit(mark)), 256).alias("payload_digest"),
        )

    validator = F.when(digit == 6, F.create_map().cast("map<string,string>")).when(digit == 4, F.create_map(F.lit("last-modified"), (F.col("page_id") * 7).cast("string")))
    validator = validator.otherwise(F.create_map(F.lit("etag"), F.when(digit == 2, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag))))
    revisit = pages.select(
        (4 * F.col("page_id") + 1).alias("record_id"),
        F.concat("url", F.lit("#again")).alias("url"),
        (F.col("page_id") * 1000 + 200_000).alias("date"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.map_concat(F.create_map(*map(F.lit, ("content-length", "0", "cache-control", "max-age=90", "date", "later"))), validator).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    out = response(pages.filter(~digit.isin(3, 7)), 0, 0, 200, "").unionByName(response(pages.filter(digit == 3), 0, 0, 404, ""))
    out = out.unionByName(response(pages.filter(digit.isin(3, 8)), 3, -500_000, 200, "old")).unionByName(response(pages.filter(digit.isin(1, 5)), 2, 300_500, 200, "late"))
    return out.unionByName(revisit)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(web_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical_url", "refers_to", "outcome", "status", F.array_join(lines, "\n").alias("headers"), "payload_digest")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), least=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=1024, end_id=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    rows = rows.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(held_out(), leaf(lower_ascii(F.col("text")))).alias("altered"))
    found = manifest(rows, keep=("altered",)).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda level: F.concat(level["left"], level["right"])), "")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", verified)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_text,
        op3_revisits,
        op4_bpe,
        op5_exact_dedup,
        op6_line_dedup,
        op7_top_k,
        op8_near_dup,
        op9_packing,
        op10_quality,
        op11_merkle,
        op12_quality_rules,
        op13_alignment,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

#: The address, spelt as ``canonical_url`` spells it, of the column ``url``.
_CANONICAL = r"""
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''),
        CASE WHEN url ILIKE 'http:%' THEN ':80$' ELSE ':443$' END, ''), '^www[.]', '')
    || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)'))), '&'), ''), '')
"""

#: Whether 5 divides the CRC-32 of ``doc_id``'s decimal text.
_FIFTH = """
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
        lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) % 5 = 0
"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: Siblings on the left and right of each node below a root.
_SIBLINGS = """
    SELECT key, level, i, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY key, level) AS n FROM {0}) WHERE n > 1
    WINDOW run AS (PARTITION BY key, level, i // 16 ORDER BY i)
"""
_PARENTS = """
    SELECT key, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {0}) WHERE n > 1
    GROUP BY key, level, i // 16
"""

ORACLE_SQL: dict[str, str] = {
    "op3_revisits": f"""
        WITH u AS (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN 'http://hot.example.com/' ELSE url END AS url FROM pages),
        p AS (SELECT *, page_id % 10 AS digit, '"' || left(md5(html), 12) || '"' AS tag, {_CANONICAL} AS canonical_url FROM u),
        stored AS (SELECT 4 * page_id + n AS refers_to, canonical_url, page_id * 1000 + seconds AS date, sha256(html || mark) AS digest, mark || tag AS tag, (page_id * 7)::VARCHAR AS modified,
            strlen(html)::VARCHAR AS bytes FROM p, (VALUES (0, 0, '', [0, 1, 2, 4, 5, 6, 8, 9]), (3, -500000, 'old', [3, 8]), (2, 300500, 'late', [1, 5])) v(n, seconds, mark, digits) WHERE list_contains(digits, digit)),
        asks AS (SELECT 4 * page_id + 1 AS record_id, canonical_url, page_id * 1000 + 200000 AS date, CASE WHEN digit NOT IN (4, 6) THEN CASE WHEN digit = 2 THEN '"new"' ELSE 'W/' || tag END END AS own_tag,
            CASE WHEN digit = 4 THEN (page_id * 7)::VARCHAR END AS own_modified FROM p),
        hit AS (SELECT a.record_id, max_by(s, (s.date, s.refers_to)) AS s FROM asks a JOIN stored s ON s.canonical_url = a.canonical_url AND s.date < a.date GROUP BY a.record_id),
        o AS (SELECT a.*, s, CASE WHEN s IS NULL THEN 'missing' WHEN replace(own_tag, 'W/', '') <> s.tag OR own_modified <> s.modified THEN 'changed'
            WHEN own_tag IS NULL AND own_modified IS NULL THEN 'unchecked' ELSE 'resolved' END AS outcome FROM asks a LEFT JOIN hit USING (record_id)),
        m AS (SELECT *, outcome IN ('resolved', 'unchecked') AS merges FROM o)
        SELECT record_id, canonical_url, s.refers_to AS refers_to, outcome, CASE WHEN merges THEN 200 ELSE 304 END AS status,
            CASE WHEN merges THEN 'cache-control: max-age=90' || chr(10) || 'content-length: ' || s.bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: later' || chr(10)
                    || 'etag: ' || coalesce(own_tag, s.tag) || chr(10) || 'last-modified: ' || s.modified
                ELSE 'cache-control: max-age=90' || chr(10) || 'content-length: 0' || chr(10) || 'date: later' || coalesce(chr(10) || 'etag: ' || own_tag, '') || coalesce(chr(10) || 'last-modified: ' || own_modified, '') END AS headers,
            CASE WHEN merges THEN s.digest END AS payload_digest FROM m
    """,
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op6_line_dedup": f"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM t),
        k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
        c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        d AS (SELECT doc_id, i, line, first IS NOT NULL AND doc_id <> first AS lost FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op7_top_k": """
        WITH f AS (SELECT vec_id, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM f),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_merkle": f"""
        WITH RECURSIVE c AS (SELECT list(list_reduce([c] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY c) AS crc FROM range(256) t(c)),
        d AS (SELECT doc_id, coalesce('=' || source, '-') AS key, {_LEAF.format("text")} AS leaf, CASE WHEN {_FIFTH} THEN {_LEAF.format(_LOWER.format("text"))} END AS altered FROM documents CROSS JOIN c),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        nodes AS (SELECT key, 0 AS level, i, leaf AS h FROM leaves UNION ALL {_PARENTS.format("nodes")}),
        subroots AS (SELECT key, max_by(h, level) AS subroot, row_number() OVER (ORDER BY key) - 1 AS place FROM nodes GROUP BY key),
        upper_nodes AS (SELECT '' AS key, 0 AS level, place AS i, subroot AS h FROM subroots UNION ALL {_PARENTS.format("upper_nodes")}),
        top AS (SELECT max_by(h, level) AS root FROM upper_nodes),
        s AS MATERIALIZED ({_SIBLINGS.format("nodes")}), u AS MATERIALIZED ({_SIBLINGS.format("upper_nodes")}),
        up AS (SELECT key, i AS leaf_at, 0 AS level, i, coalesce(altered, leaf) AS h, '' AS p FROM leaves
            UNION ALL SELECT up.key, leaf_at, up.level + 1, up.i // 16, sha256(l || h || r), p || l || r FROM up JOIN s ON s.key = up.key AND s.level = up.level AND s.i = up.i),
        there AS (SELECT key, leaf_at, max_by(h, level) AS h, max_by(p, level) AS p FROM up GROUP BY key, leaf_at),
        further AS (SELECT t.key, leaf_at, 0 AS level, place AS i, h, p FROM there t JOIN subroots USING (key)
            UNION ALL SELECT f.key, leaf_at, f.level + 1, f.i // 16, sha256(l || h || r), p || l || r FROM further f JOIN u ON u.level = f.level AND u.i = f.i),
        folded AS (SELECT key, leaf_at, max_by(h, level) AS folded_root, sha256(max_by(p, level)) AS proof_sha256 FROM further GROUP BY key, leaf_at)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves l JOIN folded f ON f.key = l.key AND f.leaf_at = l.i JOIN subroots s ON s.key = l.key CROSS JOIN top
    """,
}
