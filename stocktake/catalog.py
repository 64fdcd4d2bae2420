"""Queries over the driver's tables, one or more for every operator, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import etag, keys
from stocktake.functions.predicate import bindings, compile_filter, keep_column
from stocktake.operators import diff as D
from stocktake.operators import listing as L
from stocktake.operators import summary as S
from stocktake.operators import trace as T
from stocktake.plans import hints, manifest, probe
from stocktake.sources import adapters as A
from stocktake.sources import sinks
from stocktake.streaming import trace_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = "(SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS Key, n_chars AS Size, 1704067200 + doc_id * 60 AS LastModified, md5(text) AS ETag, doc_id FROM documents)"
D_SQL = f"(SELECT Key, Size, LastModified, ETag FROM {DOCS})"
LEFT = f"(SELECT Key, Size, LastModified, ETag FROM {DOCS} WHERE doc_id % 11 <> 3)"
RIGHT = f"(SELECT Key, Size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS Size, LastModified, CASE WHEN doc_id % 13 = 0 THEN repeat('0', 32) ELSE ETag END AS ETag FROM {DOCS} WHERE doc_id % 7 <> 2)"
PAGES = "(SELECT regexp_replace(url, '^https?://', '') AS Key, CAST(strlen(html) AS BIGINT) AS Size, 1704067200 + page_id * 60 AS LastModified, md5(html) AS ETag FROM pages)"
TALKS = "(SELECT 'conv/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/' || lpad(CAST(turn AS VARCHAR), 4, '0') || '-' || role || '.txt' AS Key, CAST(strlen(text) AS BIGINT) AS Size, 1704067200 + conv_id * 3600 + turn * 60 AS LastModified, md5(text) AS ETag FROM conversations)"
EVENTS = "(SELECT 'user/' || CAST(user_id AS VARCHAR) || '/' || event_type AS Key, CAST(floor(value * 100) AS BIGINT) AS Size, CAST(floor(epoch(ts)) AS BIGINT) AS LastModified, md5(props) AS ETag, event_id AS seq FROM events)"
CALLS = """(SELECT ts AS timestamp, CASE WHEN event_type = 'signup' THEN 'HeadBucket' ELSE 'ListObjectsV2' END AS operation,
  CASE WHEN event_id % 2 = 0 THEN 'path' ELSE 'virtual' END AS addressing_style,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'SlowDown' WHEN event_type = 'error' THEN 'InternalError' END AS s3_error_code,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CASE WHEN user_id % 3 = 0 THEN 'k' || CAST(event_id AS VARCHAR) END AS start_after,
  CASE WHEN user_id % 5 = 0 THEN 't' END AS continuation_token, CASE WHEN user_id % 7 = 0 THEN 'n' END AS next_continuation_token,
  user_id % 4 AS segment_index, user_id AS segment_objects FROM events)"""
BOUNDS = ["src12/", "src3/", "src7/en/"]
SEGMENT = "(CASE WHEN 'src12/' < Key THEN 1 ELSE 0 END + CASE WHEN 'src3/' < Key THEN 1 ELSE 0 END + CASE WHEN 'src7/en/' < Key THEN 1 ELSE 0 END)"


def prefix_sql(key: str = "Key") -> str:
    return f"CASE WHEN instr({key}, '/') = 0 THEN '/' ELSE regexp_extract({key}, '^(.*)/', 1) END"


def register(sql: str | None = None):  # noqa: ANN201
    """A query, and its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def filtered(df: DataFrame, text: str) -> DataFrame:
    return L.gate(df, text)


# --- scans, scopes, projections ---------------------------------------------


@register(f"SELECT Key, Size, LastModified, ETag, CAST(0 AS SMALLINT) AS DiffFlag FROM {D_SQL} WHERE starts_with(Key, 'src1')")
def list_parquet(spark, sf):
    return L.output(L.scope(A.documents(spark, sf), "src1"))


@register(f"SELECT Key, Size, LastModified, ETag FROM {PAGES}")
def list_pages(spark, sf):
    return L.conform(A.pages(spark, sf))


@register(f"SELECT Key, Size, LastModified, ETag FROM {TALKS}")
def list_conversations(spark, sf):
    return L.conform(A.conversations(spark, sf))


@register(f"SELECT Key, Size, LastModified, ETag FROM {D_SQL} WHERE Key > 'src15/en/'")
def list_start_after(spark, sf):
    return L.scope(A.documents(spark, sf), start_after="src15/en/")


@register(f"SELECT Key, Size FROM {D_SQL} WHERE Key > 'src12/' AND Key <= 'src3/'")
def list_segment(spark, sf):
    return L.scope(A.documents(spark, sf), segment=("src12/", "src3/")).select("Key", "Size")


@register(f"SELECT Key, CAST({SEGMENT} AS INTEGER) AS segment_index FROM {D_SQL}")
def list_segment_assign(spark, sf):
    return L.with_segment(A.documents(spark, sf), BOUNDS).select("Key", "segment_index")


@register(f"SELECT CAST({SEGMENT} AS INTEGER) AS segment_index, CAST(count(*) AS BIGINT) AS objects FROM {D_SQL} GROUP BY 1")
def list_segment_counts(spark, sf):
    return S.segment_counts(A.documents(spark, sf), BOUNDS)


@register(f"SELECT Key FROM {D_SQL} WHERE {SEGMENT} NOT IN (0, 2)")
def list_resume_remaining(spark, sf):
    return L.remaining(A.documents(spark, sf), BOUNDS, [0, 2]).select("Key")


@register("SELECT Key FROM (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS Key FROM documents UNION ALL SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) FROM documents) WHERE starts_with(Key, 'src1/') AND NOT contains(substr(Key, 6), '/')")
def list_delimiter_objects(spark, sf):
    docs = A.load(spark, sf, "documents")
    flat = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("Key"))
    deep = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("Key"))
    return L.objects_at_level(flat.union(deep), "src1/", "/")


@register(f"SELECT DISTINCT 'src1/' || split_part(substr(Key, 6), '/', 1) || '/' AS Prefix FROM {D_SQL} WHERE starts_with(Key, 'src1/') AND contains(substr(Key, 6), '/')")
def list_common_prefixes(spark, sf):
    return L.common_prefixes(A.documents(spark, sf), "src1/", "/")


@register(f"SELECT Key, CASE WHEN instr(Key, '/') = 0 THEN '/' ELSE regexp_extract(Key, '^(.*)/', 1) END AS Prefix, regexp_extract(Key, '([^/]*)$', 1) AS Name FROM {PAGES}")
def key_prefix_name(spark, sf):
    key = F.col("Key")
    return A.pages(spark, sf).select("Key", keys.prefix(key).alias("Prefix"), keys.name(key).alias("Name"))


@register(f"SELECT Key, CASE WHEN instr(Key, '/') = 0 THEN Key ELSE regexp_extract(Key, '^(.*)/', 1) || '/' || regexp_extract(Key, '([^/]*)$', 1) END AS Encoded FROM {D_SQL}")
def key_encode(spark, sf):
    key = F.col("Key")
    return A.documents(spark, sf).select("Key", keys.encode(keys.prefix(key), keys.name(key)).alias("Encoded"))


@register(f"SELECT Key, split_part(Key, '/', 1) || '/' || split_part(Key, '/', 2) || '/,' || split_part(Key, '/', 1) || '/,' AS Ladder FROM {D_SQL}")
def key_ancestors(spark, sf):
    return A.documents(spark, sf).select("Key", F.array_join(keys.ancestors(F.col("Key")), ",").alias("Ladder"))


@register(
    f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ETag WHEN 1 THEN ETag || '-37' WHEN 5 THEN ETag || '-4294967295' ELSE repeat('0', 32) END AS ETag, CASE doc_id % 6 WHEN 1 THEN 37 WHEN 5 THEN 4294967295 ELSE 0 END AS parts, doc_id % 6 IN (0, 1, 5) AS available FROM {DOCS}"
)
def etag_parse(spark, sf):
    md5, d = F.md5("text"), F.col("doc_id") % 6
    q = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    raw = F.when(d == 0, q(F.upper(md5))).when(d == 1, q(md5, F.lit("-37"))).when(d == 2, md5).when(d == 3, q(md5, F.lit("-"))).when(d == 4, q(md5, F.lit("-4294967296"))).otherwise(q(md5, F.lit("-4294967295")))
    tag = A.load(spark, sf, "documents").select("doc_id", etag.parse(raw).alias("t"))
    shown = etag.render(F.col("t.md5"), F.col("t.parts"))
    return tag.select("doc_id", shown.alias("ETag"), F.col("t.parts").alias("parts"), etag.available(shown).alias("available"))


@register(f"SELECT Key, ETag <> repeat('0', 32) AS available FROM {RIGHT}")
def etag_available(spark, sf):
    return A.diff_sides(spark, sf)[1].select("Key", etag.available(F.col("ETag")).alias("available"))


# --- filters -------------------------------------------------------------------


@register(f"SELECT Key, Size, LastModified, ETag FROM {D_SQL} WHERE Size > 1000")
def list_filter_size(spark, sf):
    return filtered(A.documents(spark, sf), "SOURCE.size > 1000")


@register(f"SELECT Key, Size FROM {D_SQL} WHERE NOT (Size <= 500 OR LastModified >= 1704090000) AND Size <> 777")
def list_filter_logic(spark, sf):
    return filtered(A.documents(spark, sf), "!(SOURCE.size <= 500 || SOURCE.last_modified >= 1_704_090_000) && SOURCE.size != 777").select("Key", "Size")


@register(f"SELECT Key, Size FROM {D_SQL} WHERE (Size * 3 - 7) % 10 = 4 OR CAST(Size AS DOUBLE) / 2 > 1500.5")
def list_filter_arith(spark, sf):
    return filtered(A.documents(spark, sf), "(SOURCE.size * 3 - 7) % 10 == 4 || SOURCE.size / 2.0 > 1500.5").select("Key", "Size")


@register(f"SELECT Key, Size FROM {D_SQL} WHERE CASE WHEN Size % 5 - 1 = 0 THEN true ELSE 1000 // CASE WHEN Size % 5 - 1 = 0 THEN 1 ELSE Size % 5 - 1 END > 400 END")
def list_filter_error_keeps(spark, sf):
    return filtered(A.documents(spark, sf), "1000 / (SOURCE.size % 5 - 1) > 400").select("Key", "Size")


@register(f"SELECT Key, CASE WHEN Size % 3 - 1 = 0 THEN NULL WHEN 100 // CASE WHEN Size % 3 - 1 = 0 THEN 1 ELSE Size % 3 - 1 END > 60 THEN Size > 2000 ELSE false END AS v FROM {D_SQL}")
def filter_three_valued(spark, sf):
    from stocktake.functions.predicate import value_column

    tree = compile_filter("100 / (SOURCE.size % 3 - 1) > 60 && SOURCE.size > 2000")
    return A.documents(spark, sf).select("Key", value_column(tree, bindings({c: F.col(c) for c in ("Size", "LastModified")})).alias("v"))


# --- aggregates and order ---------------------------------------------------------


@register(f"SELECT {prefix_sql()} AS Prefix, CAST(count(*) AS BIGINT) AS objects, CAST(sum(Size) AS BIGINT) AS bytes FROM {D_SQL} GROUP BY 1")
def prefix_stats(spark, sf):
    return S.prefix_stats(A.documents(spark, sf)).withColumn("bytes", F.col("bytes").cast("long"))


@register(f"SELECT {prefix_sql()} AS Prefix, CAST(count(*) AS BIGINT) AS objects, CAST(sum(Size) AS BIGINT) AS bytes FROM {D_SQL} GROUP BY 1 ORDER BY objects DESC, bytes DESC, Prefix LIMIT 32")
def top_prefixes(spark, sf):
    return S.top_prefixes(S.prefix_stats(A.documents(spark, sf))).withColumn("bytes", F.col("bytes").cast("long"))


@register(f"SELECT {prefix_sql()} AS Prefix, CAST(count(*) AS BIGINT) AS objects FROM {PAGES} GROUP BY 1 ORDER BY objects DESC, sum(Size) DESC, Prefix LIMIT 10")
def top_ten_prefixes(spark, sf):
    return S.top_prefixes(S.prefix_stats(A.pages(spark, sf)), 10).select("Prefix", "objects")


@register(
    f"SELECT CAST(count(*) AS BIGINT) AS received_objects, CAST(count(*) FILTER (WHERE Size > 1000) AS BIGINT) AS streamed_rows, CAST(count(DISTINCT {prefix_sql()}) FILTER (WHERE Size > 1000) AS BIGINT) AS unique_prefixes, CAST(sum(Size) FILTER (WHERE Size > 1000) AS BIGINT) AS bytes_total FROM {D_SQL}"
)
def summary_metrics(spark, sf):
    kept = keep_column(compile_filter("SOURCE.size > 1000"), bindings({c: F.col(c) for c in ("Size", "LastModified")}), True)
    return S.list_metrics(A.documents(spark, sf), kept).withColumn("bytes_total", F.col("bytes_total").cast("long"))


@register(f"SELECT {prefix_sql()} AS Prefix, CAST(count(*) AS BIGINT) AS count FROM {D_SQL} GROUP BY 1")
def ks_rows(spark, sf):
    return S.prefix_counts(A.documents(spark, sf)).orderBy("Prefix")


@register(f"SELECT '\"' || replace(Prefix, '\"', '\"\"') || '\",\"' || CAST(n AS VARCHAR) || '\"' AS line FROM (SELECT {prefix_sql()} AS Prefix, count(*) AS n FROM {PAGES} GROUP BY 1)")
def ks_lines(spark, sf):
    rows = S.prefix_counts(A.pages(spark, sf))
    return rows.select(F.concat(keys.csv_quote(F.col("Prefix")), F.lit(","), keys.csv_quote(F.col("count").cast("string"))).alias("line"))


@register("SELECT least(CAST(sum(CAST(o_orderkey AS HUGEINT) * 1000000000000000) AS HUGEINT), 18446744073709551615)::VARCHAR AS bytes FROM orders")
def saturating_bytes(spark, sf):
    size = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)")
    rows = A.load(spark, sf, "orders").select(F.least(size, F.lit(str(2**64 - 1)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("Size"))
    return rows.agg(S.saturating_sum(F.col("Size")).cast("string").alias("bytes"))


# --- sinks as rows --------------------------------------------------------------------


@register(f"SELECT replace(replace(replace(replace(Key, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || chr(9) || CAST(Size AS VARCHAR) || chr(9) || CAST(LastModified AS VARCHAR) AS value FROM (SELECT text AS Key, n_chars AS Size, 1704067200 + doc_id * 60 AS LastModified FROM documents)")
def tsv_rows(spark, sf):
    docs = A.load(spark, sf, "documents")
    return sinks.tsv_lines(docs.select(F.col("text").alias("Key"), F.col("n_chars").alias("Size"), (F.lit(A.EPOCH) + F.col("doc_id") * 60).alias("LastModified")))


@register(f"SELECT '{{\"k\":\"' || Key || '\",\"s\":' || CAST(Size AS VARCHAR) || ',\"m\":' || CAST(LastModified AS VARCHAR) || '}}' AS value FROM {D_SQL}")
def ndjson_rows(spark, sf):
    return sinks.ndjson_lines(A.documents(spark, sf))


# --- diffs --------------------------------------------------------------------------------

FLAGGED = f"""(SELECT coalesce(l.Key, r.Key) AS Key, CASE WHEN l.Key IS NULL THEN r.Size ELSE l.Size END AS Size, CASE WHEN l.Key IS NULL THEN r.LastModified ELSE l.LastModified END AS LastModified,
  CASE WHEN l.Key IS NULL THEN r.ETag ELSE l.ETag END AS ETag, l.Size AS ls, r.Size AS rs,
  CAST(CASE WHEN r.Key IS NULL THEN 1 WHEN l.Key IS NULL THEN 2 WHEN l.Size <> r.Size OR l.ETag <> r.ETag OR l.ETag = repeat('0', 32) THEN 3 ELSE 0 END AS SMALLINT) AS DiffFlag
  FROM {LEFT} l FULL OUTER JOIN {RIGHT} r ON l.Key = r.Key)"""
ROWS = "Key, Size, LastModified, ETag, DiffFlag"


def _diff(spark, sf, text=None):
    return D.diff(*A.diff_sides(spark, sf), text)


@register(f"SELECT {ROWS} FROM {FLAGGED}")
def diff_all(spark, sf):
    return _diff(spark, sf).rows


@register(f"SELECT DiffFlag, CAST(count(*) AS BIGINT) AS n FROM {FLAGGED} GROUP BY 1")
def diff_flag_counts(spark, sf):
    return _diff(spark, sf).rows.groupBy("DiffFlag").agg(F.count("*").alias("n"))


@register(
    f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN DiffFlag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS equal, CAST(sum(CASE WHEN DiffFlag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS left_only, CAST(sum(CASE WHEN DiffFlag = 2 THEN 1 ELSE 0 END) AS BIGINT) AS right_only, CAST(sum(CASE WHEN DiffFlag = 3 THEN 1 ELSE 0 END) AS BIGINT) AS different, CAST(0 AS BIGINT) AS ignored, CAST(count(*) AS BIGINT) AS keys FROM {FLAGGED}"
)
def diff_counters(spark, sf):
    return _diff(spark, sf).counts()


@register(f"SELECT Key, Size FROM {LEFT} l WHERE NOT EXISTS (SELECT 1 FROM {RIGHT} r WHERE r.Key = l.Key)")
def diff_left_only(spark, sf):
    left, right = A.diff_sides(spark, sf)
    return left.join(right, "Key", "left_anti").select("Key", "Size")


@register(f"SELECT Key, Size FROM {FLAGGED} WHERE DiffFlag = 2")
def diff_right_only(spark, sf):
    return _diff(spark, sf).rows.where("DiffFlag = 2").select("Key", "Size")


@register(f"SELECT {ROWS} FROM {FLAGGED} WHERE DiffFlag = 3")
def diff_changed(spark, sf):
    return _diff(spark, sf).rows.where("DiffFlag = 3")


@register(f"SELECT {ROWS} FROM {FLAGGED} WHERE DiffFlag = 0")
def diff_equal(spark, sf):
    return _diff(spark, sf).rows.where("DiffFlag = 0")


@register(f"SELECT {ROWS} FROM {FLAGGED} WHERE Size > 1500")
def diff_filter_source(spark, sf):
    return _diff(spark, sf, "SOURCE.size > 1500").rows


@register(f"SELECT {ROWS} FROM {FLAGGED} WHERE ls IS NULL OR rs IS NULL OR rs - ls > 0 OR rs < 900")
def diff_filter_target(spark, sf):
    return _diff(spark, sf, "TARGET.size - SOURCE.size > 0 || TARGET.size < 900").rows


@register(f"SELECT CAST(sum(CASE WHEN Size > 1500 THEN 1 ELSE 0 END) AS BIGINT) AS rows, CAST(sum(CASE WHEN Size > 1500 THEN 0 ELSE 1 END) AS BIGINT) AS ignored, CAST(count(*) AS BIGINT) AS keys FROM {FLAGGED}")
def diff_ignored(spark, sf):
    return _diff(spark, sf, "SOURCE.size > 1500").counts().select("rows", "ignored", "keys")


@register(f"SELECT {prefix_sql()} AS Prefix, CAST(count(*) AS BIGINT) AS objects, CAST(sum(Size) AS BIGINT) AS bytes FROM {FLAGGED} GROUP BY 1")
def diff_prefix_stats(spark, sf):
    return _diff(spark, sf, "SOURCE.size > 1500").prefix_stats().withColumn("bytes", F.col("bytes").cast("long"))


@register(f"SELECT Key, Size, LastModified, ETag FROM (SELECT *, row_number() OVER (PARTITION BY Key ORDER BY seq DESC) AS k FROM {EVENTS}) WHERE k = 1")
def diff_dedupe_latest(spark, sf):
    return D.dedupe_latest(A.events_dups(spark, sf), "seq")


LATEST = "(SELECT Key, Size, LastModified, ETag FROM (SELECT *, row_number() OVER (PARTITION BY Key ORDER BY seq DESC) AS k FROM (SELECT * FROM {} WHERE {})) WHERE k = 1)"
ONE, TWO = LATEST.format(EVENTS, "seq % 3 <> 0"), LATEST.format(EVENTS, "seq % 5 <> 1")


@register(
    f"SELECT coalesce(l.Key, r.Key) AS Key, coalesce(l.Size, r.Size) AS Size, CASE WHEN r.Key IS NULL THEN 1 WHEN l.Key IS NULL THEN 2 WHEN l.Size = r.Size AND l.ETag = r.ETag THEN 0 ELSE 3 END AS flag FROM {ONE} l FULL JOIN {TWO} r ON l.Key = r.Key"
)
def diff_repeated_keys(spark, sf):
    """The path of a whole run: sides with repeated keys, of which the latest counts."""
    rows = A.events_dups(spark, sf)
    sides = (D.unique(D.numbered(rows.where(p))) for p in ("seq % 3 <> 0", "seq % 5 <> 1"))
    return D.diff(*sides).rows.select("Key", "Size", F.col("DiffFlag").cast("int").alias("flag"))


# --- sets, boundaries, order --------------------------------------------------------------------


@register(f"SELECT Key, Size FROM {D_SQL} WHERE Key <= 'src3/' UNION ALL SELECT Key, Size FROM {D_SQL} WHERE Key > 'src3/'")
def union_parts(spark, sf):
    docs = A.documents(spark, sf).select("Key", "Size")
    return D.union_parts(L.scope(docs, segment=(None, "src3/")), L.scope(docs, segment=("src3/", None)))


@register("SELECT string_agg(b, ',' ORDER BY b) AS boundaries FROM (SELECT DISTINCT source || '/' AS b FROM documents)")
def boundary_dedup(spark, sf):
    docs = A.load(spark, sf, "documents").select(F.concat("source", F.lit("/")).alias("b"))
    return docs.agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("boundaries"))


@register("SELECT CAST(count(*) AS BIGINT) AS faults FROM (SELECT Key, lag(Key) OVER (PARTITION BY g ORDER BY seq) AS before FROM (SELECT *, seq % 8 AS g FROM " + EVENTS + ")) WHERE Key < before")
def order_guard(spark, sf):
    rows = A.events_dups(spark, sf).withColumn("part", F.col("seq") % 8)
    return D.order_faults(rows, "seq").agg(F.count("*").alias("faults"))


@register("SELECT x AS segment_index FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS x) WHERE x NOT IN (1, 3, 4)")
def segments_except(spark, sf):
    done = F.array_sort(F.array_union(F.array(F.lit(3), F.lit(1)), F.array(F.lit(4), F.lit(1))))
    return spark.range(1).select(F.explode(F.array_except(F.sequence(F.lit(0), F.lit(5)), done)).alias("segment_index"))


@register(f"SELECT Key FROM {LEFT} INTERSECT SELECT Key FROM {RIGHT}")
def keys_intersect(spark, sf):
    left, right = A.diff_sides(spark, sf)
    return left.select("Key").intersect(right.select("Key"))


@register(f"SELECT Key FROM {RIGHT} EXCEPT ALL SELECT Key FROM {LEFT}")
def keys_except(spark, sf):
    left, right = A.diff_sides(spark, sf)
    return right.select("Key").exceptAll(left.select("Key"))


@register("SELECT DISTINCT p FROM (SELECT source || '/' AS p FROM documents UNION ALL SELECT source || '/' || lang || '/' FROM documents)")
def discovered_prefixes(spark, sf):
    found = hints.discover(A.documents(spark, sf), 256, depth=9)
    return spark.createDataFrame([(p,) for p in found], "p string")


# --- traces ------------------------------------------------------------------------------------------


@register(f"SELECT operation, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY 1")
def trace_ops(spark, sf):
    return T.by_operation(A.trace(spark, sf))


@register(f"SELECT addressing_style, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY 1")
def trace_addressing(spark, sf):
    return T.by_addressing(A.trace(spark, sf))


@register(f"SELECT http_status, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY 1")
def trace_status(spark, sf):
    return T.status_histogram(A.trace(spark, sf))


@register(f"SELECT s3_error_code, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} WHERE s3_error_code IS NOT NULL GROUP BY 1")
def trace_errors(spark, sf):
    return T.error_counts(A.trace(spark, sf))


@register(f"SELECT CAST(count(*) FILTER (WHERE s3_error_code IN ('SlowDown', 'TooManyRequests', 'ThrottlingException')) AS BIGINT) AS throttled FROM {CALLS}")
def trace_throttles(spark, sf):
    return T.throttles(A.trace(spark, sf))


@register(f"SELECT CAST(count(start_after) AS BIGINT) AS start_after, CAST(count(continuation_token) AS BIGINT) AS continuation_token, CAST(count(next_continuation_token) AS BIGINT) AS next_continuation_token FROM {CALLS}")
def trace_presence(spark, sf):
    return T.presence(A.trace(spark, sf))


@register(f"SELECT operation, max(latency_ms) AS max_ms, CAST(quantile_cont(latency_ms, 0.5) AS DOUBLE) AS median_ms FROM {CALLS} GROUP BY 1")
def trace_latency(spark, sf):
    return T.latency(A.trace(spark, sf))


@register(f"SELECT CAST(CASE s3_error_code WHEN 'SlowDown' THEN 21 ELSE 23 END AS INTEGER) AS errno, s3_error_code AS name, false AS retryable, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} WHERE s3_error_code IS NOT NULL GROUP BY 1, 2")
def error_classification(spark, sf):
    return T.classified(A.trace(spark, sf))


@register(f"SELECT CAST(floor(epoch(timestamp)) AS BIGINT) AS t, operation, s3_error_code FROM {CALLS} WHERE s3_error_code IS NOT NULL ORDER BY timestamp, operation, s3_error_code LIMIT 5")
def trace_error_samples(spark, sf):
    return T.error_samples(A.trace(spark, sf)).select(F.unix_seconds("timestamp").alias("t"), "operation", "s3_error_code")


@register(f"SELECT segment_index, CAST(count(*) AS BIGINT) AS pages, CAST(sum(segment_objects) AS BIGINT) AS objects, CAST(0 AS BIGINT) AS common_prefixes, CAST(sum(latency_ms) AS BIGINT) AS elapsed_ms, 'end' AS ended_by FROM {CALLS} GROUP BY 1")
def segment_summary(spark, sf):
    return T.segment_summary(A.trace(spark, sf))


@register(f"SELECT operation, http_status, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY 1, 2")
def stream_trace_counts(spark, sf):
    schema = A.load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return trace_stream.settle(trace_stream.running_counts(A.trace_columns(events)), "calls_" + uuid.uuid4().hex)


# --- reports and scalars ------------------------------------------------------------------------------------

CHECKS = "(VALUES ('a', 'run_status', 'ok'), ('a', 'parquet_rows_match_streamed_rows', 'skip'), ('a', 'artifact_parquet_metadata:parquet', 'skip'), ('b', 'artifact_parquet_schema:parquet', 'ok'), ('b', 'artifact_parquet_schema:parquet#1', 'fail'), ('b', 'artifact_exists:ks', 'fail'), ('c', 'artifact_parquet_schema:parquet', 'warn'))"
CHECK_ROWS = [("a", "run_status", "ok"), ("a", "parquet_rows_match_streamed_rows", "skip"), ("a", "artifact_parquet_metadata:parquet", "skip"), ("b", "artifact_parquet_schema:parquet", "ok"), ("b", "artifact_parquet_schema:parquet#1", "fail"), ("b", "artifact_exists:ks", "fail"), ("c", "artifact_parquet_schema:parquet", "warn")]


@register(
    f"""SELECT run, count(*) FILTER (WHERE status = 'fail') = 0 AS ok, CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE status = 'warn') AS BIGINT) AS warnings, CAST(count(*) FILTER (WHERE status = 'skip') AS BIGINT) AS skipped,
    CAST(count(*) FILTER (WHERE starts_with(name, 'artifact_exists:') AND status = 'fail') AS BIGINT) AS artifacts_missing,
    CASE WHEN count(*) FILTER (WHERE starts_with(name, 'artifact_parquet_schema:parquet') AND status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE starts_with(name, 'artifact_parquet_schema:parquet') AND status = 'warn') > 0 THEN 'warn' WHEN count(*) FILTER (WHERE starts_with(name, 'artifact_parquet_schema:parquet') AND status = 'ok') > 0 THEN 'ok' ELSE 'not_applicable' END AS parquet_schema_check
    FROM {CHECKS} t(run, name, status) GROUP BY run"""
)
def manifest_rollup(spark, sf):
    return manifest.check_table(spark.createDataFrame(CHECK_ROWS, "run string, name string, status string"))


MANIFESTS = [("m1", "success", 0, 0, 3, 3, "parquet"), ("m2", "failed", 2, 1, 3, 2, "parquet"), ("m3", "success", 0, 0, 3, 0, "ndjson")]


@register("SELECT run, name, status FROM (VALUES " + ", ".join(f"('{r}', '{n}', '{s}')" for r, n, s in [
    ("m1", "run_status", "ok"), ("m1", "exit_code", "ok"), ("m1", "fatal_errors", "ok"), ("m1", "output_errors", "ok"), ("m1", "parquet_rows_match_streamed_rows", "ok"),
    ("m2", "run_status", "fail"), ("m2", "exit_code", "fail"), ("m2", "fatal_errors", "fail"), ("m2", "output_errors", "ok"), ("m2", "parquet_rows_match_streamed_rows", "fail"),
    ("m3", "run_status", "ok"), ("m3", "exit_code", "ok"), ("m3", "fatal_errors", "ok"), ("m3", "output_errors", "ok"), ("m3", "parquet_rows_match_streamed_rows", "skip"), ("m3", "artifact_parquet_metadata:parquet", "skip"),
]) + ") t(run, name, status)")
def manifest_checks(spark, sf):
    rows = []
    for run, status, code, fatal, streamed, written, kind in MANIFESTS:
        report = {"status": status, "exit_code": code, "metrics": {"fatal_errors": fatal, "streamed_rows": streamed, "parquet_rows": written}, "outputs": {"output_format": kind}}
        rows += [(run, c.name, c.status) for c in manifest.run_checks(report)]
    return spark.createDataFrame(rows, "run string, name string, status string")


@register("SELECT run, CASE WHEN bad = 0 THEN 'compatible' WHEN bad < n THEN 'partial' ELSE 'incompatible' END AS overall_status FROM (SELECT run, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad FROM (VALUES ('a', 'ok'), ('a', 'skipped'), ('b', 'ok'), ('b', 'error'), ('c', 'error'), ('c', 'error')) t(run, status) GROUP BY run)")
def probe_rollup(spark, sf):
    return probe.overall(spark.createDataFrame([("a", "ok"), ("a", "skipped"), ("b", "ok"), ("b", "error"), ("c", "error"), ("c", "error")], "run string, status string"))


@register(f"SELECT s3_error_code, http_status, CASE WHEN http_status >= 500 THEN 'server_error' ELSE 'unknown_error' END AS diagnosis, CAST(count(*) AS BIGINT) AS calls FROM {CALLS} GROUP BY 1, 2, 3")
def probe_diagnosis(spark, sf):
    calls = A.trace(spark, sf).withColumn("diagnosis", probe.diagnosis(F.lit(None), F.col("http_status"), F.col("s3_error_code")))
    return calls.groupBy("s3_error_code", "http_status", "diagnosis").agg(F.count("*").alias("calls"))


@register("SELECT n, CASE WHEN n >= 1099511627776 THEN printf('%.2f TiB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE CAST(n AS VARCHAR) || ' B' END AS shown FROM (SELECT CAST(o_orderkey AS BIGINT) * o_orderkey * 7 AS n FROM orders)")
def human_bytes(spark, sf):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 7
    return A.load(spark, sf, "orders").select(n.alias("n")).select("n", keys.human_bytes(F.col("n")).alias("shown"))


@register("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM pages")
def sanitize_path(spark, sf):
    return A.load(spark, sf, "pages").select("page_id", keys.sanitize_path(F.col("url")).alias("safe"))


@register("SELECT sha256(string_agg(b || chr(0), '' ORDER BY b)) AS digest FROM (SELECT DISTINCT source || '/' AS b FROM documents)")
def boundary_digest(spark, sf):
    bounds = A.load(spark, sf, "documents").select(F.concat("source", F.lit("/")).alias("b")).distinct().orderBy("b")
    return spark.createDataFrame([(hints.digest([r["b"] for r in bounds.collect()]),)], "digest string")


@register("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size_bytes, CAST(length(html) - length(replace(html, chr(10), '')) AS BIGINT) AS line_count FROM pages")
def content_digest(spark, sf):
    html = F.col("html")
    return A.load(spark, sf, "pages").select("page_id", F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("size_bytes"), (F.length(html) - F.length(F.replace(html, F.lit("\n"), F.lit("")))).cast("long").alias("line_count"))


@register(f"SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(Size) AS BIGINT) AS bytes FROM {D_SQL}")
def pipe_recipes(spark, sf):
    lines = sinks.tsv_lines(A.documents(spark, sf))
    parts = lines.select(F.split("value", "\t")[1].cast("long").alias("size"))
    return parts.agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))
