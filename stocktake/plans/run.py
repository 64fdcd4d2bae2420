"""Whole runs: list an inventory or compare two, write outputs, and say what happened."""

from __future__ import annotations

import glob
import os
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import keys
from stocktake.functions.predicate import bindings, compile_filter, keep_column
from stocktake.operators.diff import Diff, diff, numbered, order_faults, unique
from stocktake.operators.listing import gate, output, remaining, scope
from stocktake.operators.summary import prefix_stats, saturating_sum, top_prefixes
from stocktake.plans import manifest
from stocktake.plans.checkpoint import Identity, Journal, start
from stocktake.plans.hints import preview
from stocktake.sources import sinks

FORMATS = ("parquet", "tsv", "ndjson")
# Exit codes 0 to 7.
EXIT_OK, EXIT_INTERNAL, EXIT_USAGE, EXIT_PROVIDER, EXIT_FATAL, EXIT_OUTPUT, EXIT_CHECK, EXIT_INTERRUPTED = range(8)


class UsageError(ValueError):
    pass


@dataclass
class Run:
    metrics: dict
    top: list[tuple[str, int, int]]
    artifacts: list[dict] = field(default_factory=list)
    elapsed: float = 0.0


def exit_code(interrupted: bool, output_errors: int, fatal_errors: int) -> int:
    """Interrupted beats output errors, which beat fatal ones."""
    return EXIT_INTERRUPTED if interrupted else EXIT_OUTPUT if output_errors else EXIT_FATAL if fatal_errors else EXIT_OK


def _check(output_format: str, summary_only: bool) -> None:
    if output_format not in FORMATS:
        raise UsageError(f"unknown format {output_format}")
    if summary_only and output_format != "parquet":
        raise UsageError("summary only goes with no other format")


def plan(listing: DataFrame, out: str, filter: str | None = None, boundaries: list[str] | None = None, output_format: str = "parquet", summary_only: bool = False) -> dict:
    """What a run would do; reads nothing."""
    _check(output_format, summary_only)
    if filter:
        compile_filter(filter)
    bounds = boundaries or []
    return {"output": out, "output_format": output_format, "summary_only": summary_only, "filter": filter, "segments": len(bounds) + 1, "boundary_preview": preview(bounds, 3), "columns": listing.columns}


#: Segments that a resumable run does in one job; it is noted in the journal after each.
WAVE = 32


def _written(spark: SparkSession, target: str, output_format: str) -> DataFrame:
    """``(Key, Size)`` of all rows below ``target``: what prefix counts are made of, so the listing is read once."""
    read = spark.read.option("recursiveFileLookup", True)
    if output_format == "parquet":
        return read.schema("Key string, Size long").parquet(target)
    if output_format == "ndjson":
        return read.schema("k string, s long").json(target).select(F.col("k").alias("Key"), F.col("s").alias("Size"))
    line = F.split("value", "\t")
    return read.text(target).select(keys.tsv_unescape(line[0]).alias("Key"), line[1].cast("long").alias("Size"))


def run_list(listing: DataFrame, out: str, prefix: str = "", start_after: str = "", filter: str | None = None, boundaries: list[str] | None = None, resume: str | None = None, output_format: str = "parquet", summary_only: bool = False, compression: str = "zstd", compression_level: int | None = 1, row_group_rows: int = 100_000, wave: int = WAVE) -> Run:
    """List into ``out``: rows, prefix counts, metrics. The listing is read once; prefixes are summed from what was written.

    With ``resume``, segments are done in waves, each in a folder of its own that is written whole or not at all, and noted
    in the journal after it; a run that goes on leaves out those noted, does an unfinished wave anew, and counts all rows.
    """
    began = time.time()
    _check(output_format, summary_only)
    if resume and (start_after or summary_only):
        raise UsageError("a resumed run takes no start key and writes rows")
    spark, bounds, target = listing.sparkSession, boundaries or [], f"{out}/rows"
    scoped = scope(listing, prefix, start_after)
    kept = F.lit(True)
    if filter:
        kept = keep_column(compile_filter(filter), bindings({c: F.col(c) for c in ("Size", "LastModified")}), True)
    total = F.coalesce(saturating_sum(F.when(kept, F.col("Size"))), F.lit(0).cast("decimal(20,0)"))

    def one(rows: DataFrame, path: str, mode: str) -> dict[str, int]:
        seen = Observation()
        gated = gate(rows.observe(seen, F.count("*").alias("received_objects"), F.count_if(kept).alias("streamed_rows"), total.alias("bytes_total")), filter)
        if output_format == "parquet":
            sinks.write_parquet(output(gated), path, compression, compression_level, row_group_rows, mode)
        else:
            (sinks.write_tsv if output_format == "tsv" else sinks.write_ndjson)(gated, path, mode)
        return {k: int(v) for k, v in seen.get.items()}

    if summary_only:
        # one aggregation: every prefix with what was received and what is kept of it
        per = scoped.groupBy(keys.prefix(F.col("Key")).alias("Prefix")).agg(F.count("*").alias("received"), F.count_if(kept).alias("objects"), total.alias("bytes")).persist(StorageLevel.MEMORY_AND_DISK)
        r = per.agg(F.sum("received"), F.sum("objects"), saturating_sum(F.col("bytes"))).first()
        metrics = dict(zip(("received_objects", "streamed_rows", "bytes_total"), (int(x or 0) for x in r)))
        stats = per.where("objects > 0").select("Prefix", "objects", "bytes")
    elif resume:
        me = Identity(bucket=out, prefix=prefix, mode="list", filter=filter)
        journal = Journal.load(resume, me, bounds) if os.path.exists(resume) else start(me, bounds)
        for done in journal.waves:
            if not os.path.isdir(f"{target}/{done}") and "://" not in out:
                raise UsageError(f"the journal notes {done}, but its rows are gone")
        todo = journal.remaining()
        for i in range(0, len(todo), wave):
            part = todo[i : i + wave]
            name = f"wave={part[0]:05}-{part[-1]:05}"
            # the range that spans the wave reaches any scan, also one that takes no alternatives
            span = (bounds[part[0] - 1] if part[0] else None, bounds[part[-1]] if part[-1] < len(bounds) else None)
            rows = remaining(scope(scoped, segment=span), bounds, sorted(set(range(journal.total_segments)) - set(part)))
            journal.waves[name] = one(rows, f"{target}/{name}", "overwrite")
            journal.complete(*part)
            journal.save(resume)
        metrics = {k: sum(w[k] for w in journal.waves.values()) for k in ("received_objects", "streamed_rows", "bytes_total")}
    else:
        metrics = one(scoped, target, "errorifexists")
    if not summary_only:
        stats = prefix_stats(_written(spark, target, output_format)).persist(StorageLevel.MEMORY_AND_DISK)
        sinks.write_prefix_counts(stats, f"{out}/prefixes", "overwrite" if resume else "errorifexists")
    metrics |= {"unique_prefixes": stats.count(), "parquet_rows": metrics["streamed_rows"] if output_format == "parquet" and not summary_only else 0, "fatal_errors": 0, "output_errors": 0}
    top = [(r["Prefix"], r["objects"], int(r["bytes"])) for r in top_prefixes(stats).collect()]
    (per if summary_only else stats).unpersist()
    return Run(metrics, top, elapsed=time.time() - began)


class OrderError(ValueError):
    """A side whose keys don't come in order."""


def run_diff(left: DataFrame, right: DataFrame, out: str, filter: str | None = None, seq: str = "seq", check_order: bool = False, compression: str = "zstd") -> Run:
    """Compare into ``out``. Of a repeated key a side's latest row counts, by ``seq`` or, without that column, as read.

    ``check_order`` refuses sides whose parts don't have their keys in order, as a merge of streams would. Nothing is
    written under ``out`` before both sides have been read and compared; a failure behind that removes what was written.
    """
    began = time.time()
    sides = [numbered(s, seq) for s in (left, right)]
    if check_order:
        for name, side in zip(("left", "right"), sides):
            if bad := order_faults(side, seq).first():
                raise OrderError(f"{name} has {bad['Key']!r} after {bad['before']!r}")
    # the join runs once: rows, counts and prefixes all come from what it has left on the executors' disks
    merged = diff(*(unique(s, seq) for s in sides), filter).merged.persist(StorageLevel.DISK_ONLY)
    found = Diff(merged)
    stats = found.prefix_stats().persist(StorageLevel.MEMORY_AND_DISK)
    counts = found.counts().first().asDict()
    try:
        sinks.write_parquet(found.rows, f"{out}/rows", compression)
        sinks.write_prefix_counts(stats, f"{out}/prefixes")
    except Exception:
        for name in ("rows", "prefixes"):
            _remove(left.sparkSession, f"{out}/{name}")
        raise
    top = [(r["Prefix"], r["objects"], int(r["bytes"])) for r in top_prefixes(stats).collect()]
    stats.unpersist()
    merged.unpersist()
    return Run(counts | {"streamed_rows": counts["rows"], "fatal_errors": 0, "output_errors": 0}, top, elapsed=time.time() - began)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def report(run: Run, out: str, path: str, command: list[str], output_format: str = "parquet", summary_only: bool = False) -> dict:
    """Write the run's manifest; local outputs are hashed, and the rows in their footers are what ``parquet_rows`` says."""
    found = [manifest.artifact("parquet" if output_format == "parquet" else output_format, p) for p in sorted(glob.glob(f"{out}/rows/**/part-*", recursive=True))]
    found += [manifest.artifact("prefixes", p) for p in sorted(glob.glob(f"{out}/prefixes/part-*"))]
    metrics = dict(run.metrics)
    if output_format == "parquet" and not summary_only:
        metrics["parquet_rows"] = sum(a["parquet"]["row_count"] for a in found if a["kind"] == "parquet")
    now = datetime.now(UTC).isoformat()
    body = {
        "status": "success", "exit_code": EXIT_OK, "finished_at": now, "elapsed_secs": run.elapsed, "command": manifest.redact(command),
        "outputs": {"output_format": output_format, "summary_only": summary_only}, "artifacts": found, "metrics": metrics, "warnings": [],
    }
    manifest.write_manifest(path, **body)
    return body


def show(run: Run) -> str:
    """A summary for people: counts, bytes, the ten largest prefixes."""
    n, unit = float(run.metrics.get("bytes_total", 0)), "B"
    for u in ("KiB", "MiB", "GiB", "TiB"):
        if n < 1024:
            break
        n, unit = n / 1024, u
    size = f"{int(n)} B" if unit == "B" else f"{n:.2f} {unit}"
    lines = [f"objects  {run.metrics.get('streamed_rows', run.metrics.get('rows', 0))}", f"bytes    {size}", f"prefixes {run.metrics.get('unique_prefixes', len(run.top))}"]
    return "\n".join([*lines, *(f"  {p}  {c}" for p, c, _ in run.top[:10])])
