"""Run manifests: made after a run, checked later."""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.schema import MANIFEST

SECRET_ARGUMENTS = ("--continuation-token", "--endpoint-url", "--endpoint")


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    message: str = ""


def redact(command: list[str]) -> list[str]:
    out, hide = [], False
    for a in command:
        if hide:
            out.append("<redacted>")
            hide = False
        elif a in SECRET_ARGUMENTS:
            out.append(a)
            hide = True
        elif a.split("=", 1)[0] in SECRET_ARGUMENTS:
            out.append(a.split("=", 1)[0] + "=<redacted>")
        else:
            out.append(a)
    return out


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _lines(path: str) -> int:
    with open(path, "rb") as f:
        return sum(block.count(b"\n") for block in iter(lambda: f.read(1 << 20), b""))


def parquet_footer(path: str) -> dict:
    meta = pq.read_metadata(path)
    return {"row_count": meta.num_rows, "row_group_count": meta.num_row_groups, "schema_fields": list(meta.schema.names)}


def artifact(kind: str, path: str) -> dict:
    if not os.path.isfile(path):
        return {"kind": kind, "path": path, "exists": False}
    out = {"kind": kind, "path": path, "exists": True, "size_bytes": os.path.getsize(path), "sha256": _sha256(path)}
    if kind == "parquet":
        return out | {"parquet": parquet_footer(path)}
    return out | {"line_count": _lines(path)}


def write_manifest(path: str, **report: object) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=1)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as rows; numbers that are missing are 0."""
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    zeros = [F.coalesce(F.col(f"metrics.{c}"), F.lit(0)).alias(c) for c in ("received_objects", "streamed_rows", "parquet_rows", "unique_prefixes", "bytes_total", "fatal_errors", "output_errors")]
    return df.withColumn("metrics", F.struct(*zeros))


def _is(name: str, ok: bool, message: str = "") -> Check:
    return Check(name, "ok" if ok else "fail", message)


def run_checks(report: dict, verify_artifacts: bool = True) -> list[Check]:
    """Checks of one manifest, in a fixed order; artifacts of a kind after the first are numbered."""
    metrics, outputs = report.get("metrics") or {}, report.get("outputs") or {}
    number = lambda k: int(metrics.get(k) or 0)
    summary, kind = bool(outputs.get("summary_only")), outputs.get("output_format") or "parquet"
    checks = [
        _is("run_status", report.get("status") == "success"),
        _is("exit_code", report.get("exit_code") == 0),
        _is("fatal_errors", number("fatal_errors") == 0),
        _is("output_errors", number("output_errors") == 0),
    ]
    if kind == "parquet" and not summary:
        checks.append(_is("parquet_rows_match_streamed_rows", number("parquet_rows") == number("streamed_rows"), f"{number('parquet_rows')} and {number('streamed_rows')}"))
    else:
        why = f"not for {'summary-only' if summary else kind} output"
        checks += [Check("parquet_rows_match_streamed_rows", "skip", why), Check("artifact_parquet_metadata:parquet", "skip", why)]
    seen: Counter[str] = Counter()
    for a in report.get("artifacts") or ():
        label = a["kind"] + (f"#{seen[a['kind']]}" if seen[a["kind"]] else "")
        seen[a["kind"]] += 1
        there = bool(a.get("path")) and os.path.exists(a["path"])
        checks.append(_is(f"artifact_exists:{label}", there))
        if there and verify_artifacts:
            checks += _artifact_checks(a, label)
    return checks


def _artifact_checks(a: dict, label: str) -> Iterable[Check]:
    if a.get("size_bytes") is not None:
        yield _is(f"artifact_size:{label}", os.path.getsize(a["path"]) == a["size_bytes"])
    if a.get("sha256") is not None:
        yield _is(f"artifact_sha256:{label}", _sha256(a["path"]) == a["sha256"])
    recorded = a.get("parquet") or {}
    if a["kind"] == "parquet" and (recorded.get("row_count") is not None or recorded.get("schema_fields")):
        try:
            now = parquet_footer(a["path"])
        except Exception as e:  # noqa: BLE001  any unreadable footer is a failed check
            yield Check(f"artifact_parquet_metadata:{label}", "fail", str(e))
            return
        if recorded.get("row_count") is not None:
            yield _is(f"artifact_parquet_rows:{label}", now["row_count"] == recorded["row_count"])
        if recorded.get("schema_fields"):
            yield _is(f"artifact_parquet_schema:{label}", now["schema_fields"] == recorded["schema_fields"])


#: Statuses from the gravest; a check that doesn't apply says nothing.
GRAVITY = ("fail", "warn", "ok", "not_applicable")


def roll_up(checks: list[Check]) -> dict:
    """Counts, and what the checks of a kind say together: the gravest of them."""
    by_kind: dict[str, list[str]] = {}
    for c in checks:
        by_kind.setdefault(c.name.split("#", 1)[0], []).append("not_applicable" if c.status == "skip" else c.status)
    said = {kind: min(found, key=GRAVITY.index) for kind, found in by_kind.items()}
    every = Counter(s for found in by_kind.values() for s in found)
    files = [s for kind, found in by_kind.items() if kind.startswith("artifact_exists:") for s in found]
    return {
        "ok": not every["fail"], "errors": every["fail"], "warnings": every["warn"], "skipped": every["not_applicable"], "artifacts_checked": len(files), "artifacts_missing": files.count("fail"),
        **{field: said.get(kind, "not_applicable") for field, kind in (("row_check", "parquet_rows_match_streamed_rows"), ("parquet_schema_check", "artifact_parquet_schema:parquet"), ("exit_code_check", "exit_code"))},
    }


def check_exit_code(checks: list[Check]) -> int:
    """0, or 6 when a check fails."""
    return 6 if any(c.status == "fail" for c in checks) else 0


def check_table(checks: DataFrame) -> DataFrame:
    """Roll-up of ``(run, name, status)`` rows, for many manifests at once."""
    shown = F.when(F.col("status") == "skip", "not_applicable").otherwise(F.col("status"))
    rank = F.when(shown == "fail", 3).when(shown == "warn", 2).when(shown == "ok", 1).otherwise(0)
    schema = F.col("name") == "artifact_parquet_schema:parquet"
    schema = schema | F.col("name").startswith("artifact_parquet_schema:parquet#")
    missing = F.col("name").startswith("artifact_exists:") & (F.col("status") == "fail")
    return checks.groupBy("run").agg(
        (F.count_if(F.col("status") == "fail") == 0).alias("ok"), F.count_if(F.col("status") == "fail").alias("errors"), F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "skip").alias("skipped"),
        F.count_if(missing).alias("artifacts_missing"),
        F.coalesce(F.max_by(F.when(schema, shown), F.when(schema, rank)), F.lit("not_applicable")).alias("parquet_schema_check"),
    )
