"""``python -m stocktake list|diff|manifest-summary|discover|compat-probe|doctor``: whole runs from the command line.

An inventory is a Parquet path, or ``folder:PATH`` for files below a folder.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions.predicate import FilterError, compile_filter
from stocktake.operators.listing import conform
from stocktake.plans import config, manifest, probe
from stocktake.plans import run as R
from stocktake.plans.checkpoint import CheckpointError
from stocktake.plans.hints import Hints, HintsError, cache_name, discover, parse_hints, preview, render_cache, usable_cache
from stocktake.sources.paged import register


def inventory(spark: SparkSession, place: str, boundaries: list[str], settings: config.Config, token: str | None = None, trace: str | None = None) -> DataFrame:
    """``seq``, where there is one, is the place of a row in its files: of repeated keys the last is the latest."""
    if not place.startswith("folder:"):
        rows = spark.read.option("recursiveFileLookup", True).parquet(place)
        return conform(rows).withColumn("seq", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    register(spark)
    options = {"path": place.removeprefix("folder:"), "prefix": settings.prefix, "delimiter": settings.delimiter, "boundaries": "\n".join(boundaries), "retries": str(settings.max_attempts), "backoff": str(settings.backoff_secs)}
    if settings.max_keys:
        options["max_keys"] = str(settings.max_keys)
    if token:
        options["continuation_token"] = token
    if trace:
        options["trace"] = trace
    return spark.read.format("objlist").options(**options).load()


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("stocktake", description=__doc__)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "diff"):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs=1 if name == "list" else 2)
        c.add_argument("--output-dir", required=True)
        for flag in ("--prefix", "--delimiter", "--filter", "--compression", "--run-manifest", "--trace-compat"):
            c.add_argument(flag)
        c.add_argument("--concurrency", type=int)
        c.add_argument("--compression-level", type=int)
        c.add_argument("--max-keys", type=int)
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--plan-json", action="store_true")
        if name == "list":
            c.add_argument("--start-after", default="")
            c.add_argument("--hints-file")
            c.add_argument("--resume")
            c.add_argument("--output-format", default="parquet", choices=R.FORMATS)
            c.add_argument("--summary-only", action="store_true")
            c.add_argument("--continuation-token")
            c.add_argument("--no-auto-hints", action="store_true")
        else:
            c.add_argument("--check-order", action="store_true")
    c = sub.add_parser("manifest-summary")
    c.add_argument("manifest")
    c.add_argument("--check", action="store_true")
    c = sub.add_parser("discover")
    c.add_argument("inputs", nargs=1)
    c.add_argument("--prefix", default="")
    c.add_argument("--concurrency", type=int)
    c = sub.add_parser("compat-probe")
    c.add_argument("probes")
    c = sub.add_parser("doctor")
    c.add_argument("--hints-file")
    c.add_argument("--prefix", default="")
    return p.parse_args(argv)


def doctor(args: argparse.Namespace) -> dict:
    """What a run would find locally: configuration and hints."""
    settings = config.apply_preset(config.load(args.config))
    out: dict = {"config": {k: v for k, v in vars(settings).items() if v not in (None, "")}}
    if args.hints_file:
        hints = read_hints(args.hints_file)
        fits, warnings = usable_cache(hints, args.prefix)
        out["hints"] = {"boundaries": len(hints.boundaries), "preview": preview(hints.boundaries), "usable": fits, "warnings": hints.warnings + warnings}
    return out


def read_hints(path: str) -> Hints:
    with open(path, encoding="utf-8") as f:
        return parse_hints(f.read())


def summary(args: argparse.Namespace) -> int:
    with open(args.manifest, encoding="utf-8") as f:
        body = json.load(f)
    checks = manifest.run_checks(body, verify_artifacts=args.check)
    print(json.dumps({"status": body.get("status"), "metrics": body.get("metrics"), "check": manifest.roll_up(checks), "failed": [c.name for c in checks if c.status == "fail"]}, indent=1))
    return manifest.check_exit_code(checks) if args.check else R.EXIT_OK


def cached(place: str, settings: config.Config) -> list[str]:
    """Boundaries of the conventional cache in the working folder, if it is there and fits."""
    path = cache_name(bucket_of(place), settings.region, settings.prefix)
    if not os.path.isfile(path):
        return []
    hints = read_hints(path)
    fits, warnings = usable_cache(hints, settings.prefix)
    for w in warnings:
        print(f"{path}: {w}", file=sys.stderr)
    return hints.boundaries if fits else []


def bucket_of(place: str) -> str:
    return place.removeprefix("folder:").rstrip("/").rsplit("/", 1)[-1]


def found_prefixes(args: argparse.Namespace) -> int:
    """Write the conventional cache of an inventory's directory prefixes; later lists split by it."""
    settings = config.apply_preset(config.load(args.config, prefix=args.prefix, concurrency=args.concurrency))
    spark = config.session(settings.threads or "*")
    bounds = discover(inventory(spark, args.inputs[0], [], settings), settings.concurrency, settings.prefix)
    path = cache_name(bucket_of(args.inputs[0]), settings.region, settings.prefix)
    with open(path, "w", encoding="utf-8") as f:
        f.write(render_cache(bucket_of(args.inputs[0]), bounds, settings.region, settings.prefix))
    print(f"{path}  {len(bounds)} boundaries")
    return R.EXIT_OK


def probes(args: argparse.Namespace) -> int:
    """What recorded probes of an endpoint say together: a JSON object a line, with ``endpoint_url`` and ``tests``."""
    spark = config.session()
    tests = "array<struct<test:string,status:string,http_status:int,s3_error_code:string,error_kind:string>>"
    runs = spark.read.option("multiLine", True).schema(f"endpoint_url string, tests {tests}").json(args.probes)
    rows = runs.select(F.col("endpoint_url").alias("run"), F.explode("tests").alias("t")).select("run", "t.*")
    said = {r["run"]: r["overall_status"] for r in probe.overall(rows).collect()}
    bad = rows.where("status = 'error'").select("run", "test", probe.diagnosis(F.col("error_kind"), F.col("http_status"), F.col("s3_error_code")).alias("diagnosis")).orderBy("run", "test")
    print(json.dumps({"overall": said, "errors": [r.asDict() for r in bad.collect()]}, indent=1))
    return R.EXIT_OK if all(s == "compatible" for s in said.values()) else R.EXIT_CHECK


def execute(args: argparse.Namespace, argv: list[str]) -> int:
    settings = config.apply_preset(config.load(args.config, prefix=args.prefix, delimiter=args.delimiter, max_keys=args.max_keys, filter=args.filter, compression=args.compression, compression_level=args.compression_level, concurrency=args.concurrency))
    token = getattr(args, "continuation_token", None)
    if token and (args.start_after or args.hints_file or args.resume):
        raise R.UsageError("a continuation token goes with neither a start key, hints nor a resumed run")
    bounds = read_hints(args.hints_file).boundaries if args.command == "list" and args.hints_file else []
    if args.command == "list" and not (bounds or args.hints_file or args.no_auto_hints or args.start_after or token):
        bounds = cached(args.inputs[0], settings)
    if settings.filter:
        compile_filter(settings.filter, diff=args.command == "diff")
    if args.command == "list" and args.start_after and (args.resume or args.hints_file):
        raise R.UsageError("a start key goes with neither hints nor a resumed run")
    if args.trace_compat and not any(p.startswith("folder:") for p in args.inputs):
        raise R.UsageError("only a listing over an API has calls to trace")
    if args.dry_run or args.plan_json:
        print(json.dumps({"command": args.command, "inputs": args.inputs, "output": args.output_dir, "filter": settings.filter, "segments": len(bounds) + 1, "boundary_preview": preview(bounds, 3), "time": datetime.now().isoformat()}))
        return R.EXIT_OK
    if args.trace_compat:
        try:
            os.makedirs(args.trace_compat, exist_ok=True)
        except OSError as e:
            print(f"no trace folder: {e}", file=sys.stderr)
            return R.EXIT_OUTPUT
    spark = config.session(settings.threads or "*")
    sides = [inventory(spark, p, bounds, settings, token, args.trace_compat) for p in args.inputs]
    kind, alone = "parquet", False
    if args.command == "list":
        kind, alone = args.output_format, args.summary_only
        run = R.run_list(sides[0], args.output_dir, settings.prefix, args.start_after, settings.filter, bounds, args.resume, kind, alone, settings.compression, settings.compression_level, settings.row_group_size)
    else:
        # a listing that is read over an API is read once
        sides = [s.persist(StorageLevel.DISK_ONLY) if p.startswith("folder:") else s for s, p in zip(sides, args.inputs)]
        run = R.run_diff(*sides, args.output_dir, settings.filter, check_order=args.check_order, compression=settings.compression)
    if args.run_manifest:
        R.report(run, args.output_dir, args.run_manifest, argv, kind, alone)
    print(R.show(run))
    return R.exit_code(False, run.metrics["output_errors"], run.metrics["fatal_errors"])


def main(argv: list[str]) -> int:
    args = arguments(argv)
    try:
        if args.command == "manifest-summary":
            return summary(args)
        if args.command == "doctor":
            print(json.dumps(doctor(args), indent=1))
            return R.EXIT_OK
        if args.command in ("discover", "compat-probe"):
            return (found_prefixes if args.command == "discover" else probes)(args)
        return execute(args, argv)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return R.EXIT_PROVIDER if "URL" in str(e) else R.EXIT_USAGE
    except R.OrderError as e:
        print(e, file=sys.stderr)
        return R.EXIT_FATAL
    except (R.UsageError, FilterError, HintsError, CheckpointError) as e:
        print(e, file=sys.stderr)
        return R.EXIT_USAGE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
