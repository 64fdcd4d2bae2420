import glob
import json

import pytest

from stocktake.operators import diff as D
from stocktake.operators import listing as L
from stocktake.operators import summary as S
from stocktake.plans import run as R
from stocktake.schema import DIFF, LISTING, NO_ETAG
from stocktake.sources import sinks
from stocktake.sources.synthetic import synthetic_listing, synthetic_sides

E = {i: f"{i:032x}" for i in range(1, 10)}


def rows(spark, *items):
    return spark.createDataFrame([(k, s, 0, e) for k, s, e in items], LISTING)


def flags(d):
    return {r["Key"]: r["DiffFlag"] for r in d.rows.collect()}


@pytest.fixture
def sides(spark):
    left = rows(spark, ("a/equal.txt", 100, E[1]), ("a/left_only.txt", 100, E[2]), ("b/changed_etag.txt", 100, E[3]), ("b/changed_size.txt", 100, E[4]))
    right = rows(spark, ("a/equal.txt", 100, E[1]), ("b/changed_etag.txt", 100, E[9]), ("b/changed_size.txt", 222, E[4]), ("c/right_only.txt", 100, E[5]))
    return left, right


def test_diff_flags_and_counts(sides):
    d = D.diff(*sides)
    assert flags(d) == {"a/equal.txt": 0, "a/left_only.txt": 1, "b/changed_etag.txt": 3, "b/changed_size.txt": 3, "c/right_only.txt": 2}
    assert d.counts().first().asDict() == {"rows": 5, "equal": 1, "left_only": 1, "right_only": 1, "different": 2, "ignored": 0, "keys": 5}
    assert d.prefix_stats().count() == 3
    assert {r["Key"]: r["Size"] for r in d.rows.collect()}["b/changed_size.txt"] == 100
    assert d.rows.schema.names == DIFF.names


def test_unavailable_tags_differ(spark):
    side = rows(spark, ("k.txt", 100, NO_ETAG))
    assert flags(D.diff(side, side)) == {"k.txt": 3}
    assert flags(D.diff(side, rows(spark))) == {"k.txt": 1}


def test_latest_duplicate_wins(spark):
    left = spark.createDataFrame([("dup.txt", 1, 0, E[1], 1), ("dup.txt", 2, 0, E[2], 2)], "Key string, Size long, LastModified long, ETag string, seq long")
    assert flags(D.diff(D.dedupe_latest(left, "seq"), rows(spark, ("dup.txt", 2, E[2])))) == {"dup.txt": 0}


def test_diff_filter_matrix(spark):
    left = rows(spark, ("a", 999, E[1]), ("b", 1001, E[1]), ("c", 999, E[1]), ("d", 1001, E[1]))
    right = rows(spark, ("c", 1001, E[1]), ("d", 999, E[1]), ("e", 999, E[1]), ("f", 1001, E[1]))
    d = D.diff(left, right, "SOURCE.size > 1000")
    assert flags(d) == {"b": 1, "d": 3, "f": 2}
    assert d.counts().first()["ignored"] == 3 and d.prefix_stats().first()["objects"] == 6
    assert flags(D.diff(left, right, "TARGET.size > 1000 || false")) == {"a": 1, "b": 1, "c": 3, "e": 2, "f": 2}
    assert flags(D.diff(left, right, "SOURCE.size > 0 || TARGET.size > 0")) == {"a": 1, "b": 1, "c": 3, "d": 3, "e": 2, "f": 2}


def test_diff_shapes(spark):
    counts = D.diff(*synthetic_sides(spark, 4000)).counts().first()
    # object 0 has an all-zero tag, which counts as unavailable and so differs
    assert (counts["equal"], counts["left_only"], counts["right_only"], counts["different"]) == (999, 1000, 1000, 1001)
    assert D.diff(*synthetic_sides(spark, 100, shape="all-changed")).counts().first()["different"] == 100


def test_order_faults(spark):
    df = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3)], "Key string, seq long").coalesce(1)
    assert [r["Key"] for r in D.order_faults(df, "seq").collect()] == ["b"]


def test_list_filter_and_prefix_counts(spark, tmp_path):
    listing = rows(spark, ("p/a.txt", 100, E[1]), ("p/b.txt", 101, E[2]), ("p/c.txt", 102, E[3]))
    run = R.run_list(listing, str(tmp_path / "o"), filter="SOURCE.size > 101")
    assert run.metrics["received_objects"] == 3 and run.metrics["streamed_rows"] == 1 and run.metrics["bytes_total"] == 102
    assert [r["Key"] for r in spark.read.parquet(str(tmp_path / "o/rows")).collect()] == ["p/c.txt"]
    assert "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "o/prefixes/part-*")))) == '"p","1"\n'
    assert "102 B" in R.show(run)


def test_summary_only(spark, tmp_path):
    listing = rows(spark, ("p/a.txt", 100, E[1]), ("p/b.txt", 100, E[2]), ("c.txt", 101, E[3]))
    run = R.run_list(listing, str(tmp_path / "o"), summary_only=True)
    assert run.metrics["parquet_rows"] == 0 and run.metrics["bytes_total"] == 301 and run.metrics["unique_prefixes"] == 2
    with pytest.raises(R.UsageError):
        R.run_list(listing, str(tmp_path / "x"), summary_only=True, output_format="tsv")


def test_resume_lists_each_key_once(spark, tmp_path):
    from stocktake.plans.checkpoint import CheckpointError, Identity, start

    listing = rows(spark, *[(k, 1, E[1]) for k in ("a.txt", "m/", "n.txt", "t/", "u.txt", "z.txt")])
    bounds, out, journal = ["m/", "t/"], str(tmp_path / "o"), str(tmp_path / "j.json")
    me = Identity(bucket=out, mode="list")
    j = start(me, bounds)
    j.complete(0)
    j.save(journal)
    R.run_list(listing, out, boundaries=bounds, resume=journal)
    assert sorted(r["Key"] for r in spark.read.parquet(out + "/rows").collect()) == ["n.txt", "t/", "u.txt", "z.txt"]
    with pytest.raises(CheckpointError):
        R.run_list(listing, out, boundaries=["m/", "u/"], resume=journal)
    with pytest.raises(CheckpointError):
        R.run_list(listing, out, boundaries=bounds, resume=journal, filter="SOURCE.size > 1")


def test_delimiter(spark):
    listing = rows(spark, *[(k, 1, E[1]) for k in ("logs/a.txt", "logs/b.txt", "logs/c.txt", "logs/archive/x", "logs/archive/y", "other")])
    assert L.objects_at_level(listing, "logs/", "/").count() == 3
    assert [r[0] for r in L.common_prefixes(listing, "logs/", "/").collect()] == ["logs/archive/"]
    assert [tuple(r) for r in S.prefix_counts(L.objects_at_level(listing, "logs/", "/")).collect()] == [("logs", 3)]


def test_sinks_bytes(spark, tmp_path):
    listing = rows(spark, ("comma,prefix/a.txt", 1, E[1]), ("multi\nline/b.txt", 1, E[1]), ("plain/c.txt", 1, E[1]), ('we"ird/d.txt', 1, E[1]), ("slash\\key.txt", 7, E[1]), ("tab\tkey.txt", 8, E[1]))
    sinks.write_prefix_counts(listing, str(tmp_path / "k"))
    assert "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "k/part-*")))) == '"/","2"\n"comma,prefix","1"\n"multi\nline","1"\n"plain","1"\n"we""ird","1"\n'
    sinks.write_tsv(listing, str(tmp_path / "t"))
    assert "tab\\tkey.txt\t8\t0" in {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()}
    assert "slash\\\\key.txt\t7\t0" in {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()}
    sinks.write_ndjson(listing, str(tmp_path / "n"))
    assert {"k": "plain/c.txt", "s": 1, "m": 0} in [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "n")).collect()]
    for codec in ("uncompressed", "snappy", "gzip", "lz4_raw", "zstd"):
        sinks.write_parquet(L.output(listing), str(tmp_path / codec), codec)
    for codec in ("brotli", "nope"):
        with pytest.raises(ValueError):
            sinks.check_codec(codec)


def test_saturation(spark):
    df = spark.createDataFrame([("a", 2**63 - 1)] * 3, "Key string, Size long")
    assert int(S.prefix_stats(df).first()["bytes"]) == 2**64 - 1


def test_repeated_keys_in_a_run(spark, tmp_path):
    """Each key once, with its latest row, as read or by a sequence."""
    left = rows(spark, ("a", 1, E[1]), ("a", 2, E[2]), ("b", 5, E[3])).coalesce(1)
    right = rows(spark, ("a", 2, E[2]), ("a", 3, E[2]), ("a", 2, E[2])).coalesce(1)
    run = R.run_diff(left, right, str(tmp_path / "o"))
    got = sorted((r["Key"], r["Size"], r["DiffFlag"]) for r in spark.read.parquet(str(tmp_path / "o/rows")).collect())
    assert got == [("a", 2, 0), ("b", 5, 1)] and run.metrics["keys"] == 2
    with pytest.raises(R.OrderError):
        R.run_diff(left.union(left).coalesce(1), right, str(tmp_path / "x"), check_order=True)
    assert not (tmp_path / "x").exists()


@pytest.mark.parametrize("kind", ["parquet", "tsv", "ndjson"])
def test_interrupted_run_goes_on(spark, tmp_path, monkeypatch, kind):
    """Waves that were finished stay; the rest is done; rows, counts and metrics are those of one run."""
    keys_ = [f"{c}{d}/x\t{i}\\" for c in "abcdef" for d in "12" for i in range(3)]
    listing = rows(spark, *[(k, i, E[1]) for i, k in enumerate(keys_)])
    bounds, journal = ["b", "c", "d", "e", "f"], str(tmp_path / "j")
    args = {"boundaries": bounds, "output_format": kind, "filter": "SOURCE.size != 4"}
    whole = R.run_list(listing, str(tmp_path / "one"), **args)
    write = R.sinks.write_parquet if kind == "parquet" else getattr(R.sinks, f"write_{kind}")
    calls = []

    def fails(df, path, *a):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("no room")
        return write(df, path, *a)

    monkeypatch.setattr(R.sinks, "write_parquet" if kind == "parquet" else f"write_{kind}", fails)
    out = str(tmp_path / "o")
    with pytest.raises(OSError):
        R.run_list(listing, out, resume=journal, wave=2, **args)
    again = R.run_list(listing, out, resume=journal, wave=2, **args)
    assert len(calls) == 4 and again.metrics == whole.metrics and again.top == whole.top
    text = lambda at: "".join(open(f).read() for f in sorted(glob.glob(f"{at}/prefixes/part-*")))
    assert text(out) == text(tmp_path / "one") and text(out)
    done = R.run_list(listing, out, resume=journal, wave=2, **args)
    assert len(calls) == 4 and done.metrics == whole.metrics and text(out) == text(tmp_path / "one")


def test_run_diff_and_manifest(spark, sides, tmp_path):
    from stocktake.plans import manifest as M

    out = str(tmp_path / "d")
    run = R.run_diff(*sides, out)
    assert run.metrics["keys"] == 5
    listed = R.run_list(sides[0], str(tmp_path / "l"))
    body = R.report(listed, str(tmp_path / "l"), str(tmp_path / "m.json"), ["list", "--endpoint-url", "https://x"])
    assert body["command"] == ["list", "--endpoint-url", "<redacted>"]
    checks = M.run_checks(body)
    assert M.check_exit_code(checks) == 0 and M.roll_up(checks)["row_check"] == "ok"
    assert M.read_manifests(spark, str(tmp_path / "m.json")).first()["metrics"]["streamed_rows"] == 4
