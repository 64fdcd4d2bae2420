"""Fixed schemas and codes of inventories, diffs, traces, manifests and probes."""

from pyspark.sql import types as T

L, S, I, B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


LISTING = _struct(("Key", S, False), ("Size", L, False), ("LastModified", L, False), ("ETag", S, False))
DIFF = T.StructType([*LISTING.fields, T.StructField("DiffFlag", T.ShortType(), False)])
PREFIX_STATS = _struct(("Prefix", S, False), ("objects", L, False), ("bytes", L, False))

#: What a diff says of a key: on both sides alike, left only, right only, on both but different.
EQUAL, LEFT_ONLY, RIGHT_ONLY, DIFFERENT = 0, 1, 2, 3
#: An entity tag that is not known.
NO_ETAG = "0" * 32
U64_MAX = 18446744073709551615
I64_MAX, I64_MIN = 2**63 - 1, -(2**63)

TRACE = _struct(
    ("timestamp", T.TimestampType()), ("operation", S), ("profile", S), ("endpoint_url", S), ("region", S), ("addressing_style", S), ("bucket", S), ("prefix", S),
    ("delimiter", S), ("start_after", S), ("max_keys", I), ("continuation_token", S),
    ("http_status", I), ("s3_error_code", S), ("s3_error_message", S), ("request_id", S), ("request_id_2", S), ("retry_attempt", I), ("latency_ms", L), ("retryable", B), ("fatal", B),
    ("is_truncated", B), ("next_continuation_token", S), ("key_count", I), ("contents_count", I), ("common_prefixes_count", I), ("next_continuation_token_present", B), ("first_key", S), ("last_key", S),
    ("segment_index", L), ("end_before", S), ("segment_pages", L), ("segment_objects", L), ("segment_common_prefixes", L), ("ended_by", S), ("truncated_raw_body", S),
)

ARTIFACT = _struct(
    ("kind", S), ("path", S), ("exists", B), ("size_bytes", L), ("sha256", S), ("line_count", L),
    ("parquet", _struct(("row_count", L), ("row_group_count", L), ("schema_fields", T.ArrayType(S)))),
)
METRICS = _struct(("received_objects", L), ("streamed_rows", L), ("parquet_rows", L), ("unique_prefixes", L), ("bytes_total", L), ("fatal_errors", L), ("output_errors", L))
MANIFEST = _struct(
    ("status", S), ("exit_code", L), ("started_at", S), ("finished_at", S), ("elapsed_secs", T.DoubleType()), ("command", T.ArrayType(S)),
    ("inputs", _struct(("bucket", S), ("prefix", S), ("filter", S), ("mode", S))),
    ("outputs", _struct(("output_format", S), ("summary_only", B))),
    ("artifacts", T.ArrayType(ARTIFACT)), ("metrics", METRICS),
    ("checkpoint", _struct(("path", S), ("resumed", B), ("completed_segments", L))), ("warnings", T.ArrayType(S)),
)
PROBE_TEST = _struct(("test", S), ("status", S), ("latency_ms", L), ("http_status", I), ("s3_error_code", S), ("error_message", S), ("error_kind", S))
PROBE = _struct(("endpoint_url", S), ("region", S), ("bucket", S), ("addressing_style", S), ("tests", T.ArrayType(PROBE_TEST)), ("overall_status", S))
