"""Compatibility probes of an endpoint: their roll-up, and what an error suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The probes, and diagnoses by error code, by status and by kind of failure.
PROBES = ["head_bucket", "list_max_keys", "list_prefix", "list_delimiter", "list_encoding_type", "list_pagination"]
BY_CODE = {
    "SignatureDoesNotMatch": "signature_mismatch",
    "InvalidAccessKeyId": "access_denied",
    "AccessDenied": "access_denied",
    "NoSuchBucket": "bucket_not_found",
    "NotImplemented": "operation_not_supported",
    "NotSupported": "operation_not_supported",
    "PermanentRedirect": "region_or_endpoint_mismatch",
    "AuthorizationHeaderMalformed": "region_or_endpoint_mismatch",
}
BY_STATUS = {
    301: "redirect",
    307: "redirect",
    308: "redirect",
    400: "bad_request",
    401: "access_denied",
    403: "access_denied",
    404: "not_found",
    405: "operation_not_supported",
    501: "operation_not_supported",
}
BY_KIND = {"timeout": "timeout", "dispatch": "transport_failure", "response": "invalid_response", "construction": "request_construction"}


def _look_up(table: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def diagnosis(kind: Column, status: Column, code: Column) -> Column:
    server = F.when(status >= 500, "server_error")
    return F.coalesce(_look_up(BY_CODE, code), _look_up(BY_STATUS, status), server, _look_up(BY_KIND, kind), F.lit("unknown_error"))


def overall(tests: DataFrame) -> DataFrame:
    """``(run, overall_status)`` of ``(run, status)`` rows; skipped probes are no errors."""
    bad = F.count_if(F.col("status") == "error")
    return tests.groupBy("run").agg(F.when(bad == 0, "compatible").when(bad < F.count("*"), "partial").otherwise("incompatible").alias("overall_status"))
