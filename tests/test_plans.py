import json
import os
from datetime import UTC, datetime, timedelta

import pytest

from stocktake.operators import trace as T
from stocktake.plans import config as C
from stocktake.plans import hints as H
from stocktake.plans import manifest as M
from stocktake.plans import probe as P
from stocktake.plans import run as R
from stocktake.plans.checkpoint import CheckpointError, Identity, Journal, start
from stocktake.schema import TRACE
from stocktake.sources.paged import FolderPager, ListingError, Page, list_segment, register
from stocktake.streaming import trace_stream


def test_plain_hints():
    h = H.parse_hints("# note\n b/ \n\na/\nb/\n")
    assert h.boundaries == ["a/", "b/"] and len(h.warnings) == 2
    for leak in ('"a/",', "boundaries = x", "]", "[boundaries]", "prefix = a"):
        with pytest.raises(H.HintsError):
            H.parse_hints(f"a/\nb/\nc/\nd/\n{leak}\n")
    assert H.parse_hints("a=b/c\nd=e/f\n").boundaries == ["a=b/c", "d=e/f"]


def test_toml_hints():
    now = datetime(2026, 1, 31, tzinfo=UTC)
    text = H.render_cache("bucket", ["a/", 'q"/'], "r", "p/", now - timedelta(days=40))
    h = H.parse_hints(text)
    assert h.boundaries == ["a/", 'q"/'] and h.prefix == "p/"
    assert H.usable_cache(h, "p/", now) == (True, ["40 days old"])
    assert not H.usable_cache(h, "", now)[0]
    with pytest.raises(H.HintsError):
        H.parse_hints('boundaries = ["a",\n')
    assert H.cache_name("b/x", "r", "p") == f"r_b_x_{__import__('hashlib').sha256(b'p').hexdigest()[:8]}_hints.toml"


def test_digest_separates():
    assert H.digest(["ab", "c"]) != H.digest(["a", "bc"]) and H.digest(["a", "b"]) != H.digest(["b", "a"])


def test_discovery(spark):
    keys = ["a/x/1", "a/y/2", "b/z/3", "c", "a/4"]
    df = spark.createDataFrame([(k,) for k in keys], "Key string")
    assert H.discover(df, 8) == ["a/", "a/x/", "a/y/", "b/", "b/z/"]
    assert H.discover(df, 8, "a/") == ["a/x/", "a/y/"]


def test_journal(tmp_path):
    me, bounds, path = Identity("b", prefix="p", mode="list"), ["m/"], str(tmp_path / "j")
    j = start(me, bounds)
    j.complete(1, 1)
    j.save(path)
    assert Journal.load(path, me, bounds).remaining() == [0]
    for other, cuts in ((Identity("c", prefix="p", mode="list"), bounds), (Identity("b", prefix="p", mode="list", filter="x"), bounds), (me, ["n/"]), (me, ["m/", "n/"])):
        with pytest.raises(CheckpointError):
            Journal.load(path, other, cuts)
    data = json.load(open(path))
    del data["boundaries_digest"]
    json.dump(data, open(path, "w"))
    with pytest.raises(CheckpointError):
        Journal.load(path, me, bounds)


def test_manifest_checks(tmp_path):
    f = tmp_path / "ks.csv"
    f.write_text('"a","1"\n')
    good = M.artifact("ks", str(f))
    assert good["line_count"] == 1
    report = {"status": "success", "exit_code": 0, "metrics": {"streamed_rows": 3, "parquet_rows": 2}, "outputs": {"output_format": "parquet"}, "artifacts": [good, {"kind": "ks", "path": str(tmp_path / "gone")}]}
    bad = {c.name for c in M.run_checks(report) if c.status == "fail"}
    assert bad == {"parquet_rows_match_streamed_rows", "artifact_exists:ks#1"}
    f.write_text("changed")
    bad = {c.name for c in M.run_checks(report) if c.status == "fail"}
    assert {"artifact_size:ks", "artifact_sha256:ks"} <= bad and M.check_exit_code(M.run_checks(report)) == 6
    summary = {"status": "success", "exit_code": 0, "outputs": {"summary_only": True}}
    rolled = M.roll_up(M.run_checks(summary))
    assert rolled["ok"] and rolled["skipped"] == 2 and rolled["row_check"] == "not_applicable"


def test_redaction_and_exit_codes():
    assert M.redact(["x", "--endpoint=https://a", "--continuation-token", "t"]) == ["x", "--endpoint=<redacted>", "--continuation-token", "<redacted>"]
    assert [R.exit_code(*a) for a in ((True, 1, 1), (False, 1, 1), (False, 0, 1), (False, 0, 0))] == [7, 5, 4, 0]


def test_plan_reads_nothing(spark):
    df = spark.createDataFrame([], "Key string, Size long")
    assert R.plan(df, "o", "SOURCE.size > 1", ["a", "b", "c", "d"])["boundary_preview"] == ["a", "b", "c"]
    with pytest.raises(R.UsageError):
        R.plan(df, "o", output_format="orc")


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[s3]\nregion = "r"\nmax_attempts = 3\n')
    c = C.load(str(f), region="q", profile="b2")
    assert (c.region, c.max_attempts) == ("q", 3)
    assert C.apply_preset(c).endpoint_url == "https://s3.q.backblazeb2.com" and C.apply_preset(c).addressing_style == "path"
    with pytest.raises(C.ConfigError):
        C.apply_preset(C.Config(profile="minio"))
    with pytest.raises(C.ConfigError):
        C.Config(concurrency=0).check()
    assert int(C.spark_settings(1 << 40, 8)["spark.sql.shuffle.partitions"]) == 8192


def test_folder_source(spark, tmp_path):
    for k in ("a.txt", "m/x", "n.txt", "t/y", "u.txt", "z.txt"):
        p = tmp_path / "r" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(k)
    register(spark)
    read = lambda **o: [r["Key"] for r in spark.read.format("objlist").options(path=str(tmp_path / "r"), **o).load().orderBy("Key").collect()]
    assert read() == ["a.txt", "m/x", "n.txt", "t/y", "u.txt", "z.txt"]
    assert read(boundaries="m/\nt/y", max_keys="1") == read()
    assert read(delimiter="/") == ["a.txt", "n.txt", "u.txt", "z.txt"]
    assert read(delimiter="/", max_keys="1") == ["a.txt", "n.txt", "u.txt", "z.txt"]
    assert read(start_after="n.txt") == ["t/y", "u.txt", "z.txt"] and read(prefix="t/") == ["t/y"]
    with pytest.raises(Exception):
        read(continuation_token="x", start_after="y")


def test_ranges_and_traces_of_listings(spark, tmp_path):
    """Ranges that a query asks for are not listed beyond; every call is traced, and every segment."""
    keys = [f"{d}/{i}" for d in "abcd" for i in range(5)]
    for k in keys:
        p = tmp_path / "r" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(k)
    register(spark)

    def read(name, condition, **o):
        rows = spark.read.format("objlist").options(path=str(tmp_path / "r"), trace=str(tmp_path / name), max_keys="2", boundaries="b/\nc/\nd/", **o).load().where(condition)
        got = sorted(r["Key"] for r in rows.collect())
        return got, T.read_trace(spark, str(tmp_path / name)).cache() if (tmp_path / name).exists() else None

    got, trace = read("all", "true")
    assert got == keys and trace.where("_corrupt_record is not null").count() == 0
    ends = {r["segment_index"]: (r["objects"], r["ended_by"]) for r in T.segment_summary(trace).collect()}
    assert ends == {0: (5, "boundary"), 1: (5, "boundary"), 2: (5, "boundary"), 3: (5, "pagination")}
    calls = trace.where("operation = 'ListObjectsV2'")
    assert calls.where("http_status = 200 and first_key <= last_key and contents_count = key_count").count() == calls.count() >= 12
    got, trace = read("range", "Key > 'b/1' and Key <= 'b/4'")
    assert got == ["b/2", "b/3", "b/4"]
    assert [(r["objects"], r["ended_by"]) for r in T.segment_summary(trace).collect()] == [(3, "boundary")]
    got, trace = read("prefix", "startswith(Key, 'c/')")
    assert got == [f"c/{i}" for i in range(5)] and {r[0] for r in trace.select("prefix").distinct().collect()} == {"c/"}
    assert read("none", "Key > 'z' and Key <= 'b'") == ([], None)


def test_failed_calls_are_traced(tmp_path):
    (tmp_path / "k").write_text("x")
    seen = []
    with pytest.raises(ListingError):
        list(list_segment(Shaky(FolderPager(str(tmp_path)), "AccessDenied", every=1), log=lambda **e: seen.append(e)))
    assert [e.get("s3_error_code") for e in seen] == ["AccessDenied", None] and seen[0]["fatal"] and seen[1]["ended_by"] == "error"


class Shaky:
    """Every other page fails."""

    def __init__(self, inner, code=None, every=2):
        self.inner, self.code, self.every, self.n = inner, code, every, 0

    def page(self, *a):
        self.n += 1
        if self.n % self.every == 0:
            raise ListingError(self.code)
        return self.inner.page(*a)


def test_retry_from_the_cursor(tmp_path):
    for i in range(20):
        (tmp_path / f"k{i:02}").write_text("x")
    got = [r[0] for r in list_segment(Shaky(FolderPager(str(tmp_path))), max_keys=3, retries=1)]
    assert got == [f"k{i:02}" for i in range(20)]
    with pytest.raises(ListingError):
        list(list_segment(Shaky(FolderPager(str(tmp_path)), "AccessDenied"), max_keys=3))

    class Down:
        def page(self, *a):
            raise ListingError(None)

    with pytest.raises(ListingError):
        list(list_segment(Down(), retries=3))
    assert Page([]).token is None


def test_pages_read_no_further(tmp_path, monkeypatch):
    """Keys come in byte order, below folders too, and a page enters no folder that lies before its cursor or behind its end."""
    for k in ("a-b", "a/1", "a/2/x", "a0", "b/1", "b/2", "c"):
        p = tmp_path / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(k)
    pager, entered = FolderPager(str(tmp_path)), []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(os.path.relpath(p, tmp_path)) or scan(p))
    keys = ["a-b", "a/1", "a/2/x", "a0", "b/1", "b/2", "c"]
    assert [r[0] for r in pager.page("", "", "", 100, None).objects] == keys
    entered.clear()
    assert [r[0] for r in pager.page("", "b/1", "", 1, None).objects] == ["b/2"] and "a" not in entered
    entered.clear()
    assert [r[0] for r in pager.page("", "", "", 2, None).objects] == ["a-b", "a/1"] and "b" not in entered
    assert [r[0] for r in pager.page("a/2", "", "", 9, None).objects] == ["a/2/x"]
    for after in [*keys, "a", "a/", "b", "zz"]:
        assert [r[0] for r in pager.page("", after, "", 100, None).objects] == [k for k in keys if k > after]


def test_probe(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "skipped"), ("c", "error")], "run string, status string")
    assert {r[0]: r[1] for r in P.overall(df).collect()} == {"a": "partial", "b": "compatible", "c": "incompatible"}
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None, 403, "SignatureDoesNotMatch"), (None, 404, None), (None, 502, None), ("timeout", None, None), (None, None, None)], "k string, s int, c string")
    got = [r[0] for r in rows.select(P.diagnosis(F.col("k"), F.col("s"), F.col("c"))).collect()]
    assert got == ["signature_mismatch", "not_found", "server_error", "timeout", "unknown_error"]


def trace_lines():
    base = {"operation": "ListObjectsV2", "addressing_style": "path", "latency_ms": 5, "http_status": 200}
    return [base | {"timestamp": f"2026-01-01T00:0{i}:00Z"} for i in range(4)] + [base | {"timestamp": "2026-01-01T00:00:30Z", "http_status": 503, "s3_error_code": "SlowDown", "latency_ms": 50}]


def test_trace_report(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, trace_lines())) + "\n\n{broken\n")
    df = T.read_trace(spark, str(tmp_path / "t.jsonl")).cache()
    assert df.where("_corrupt_record is not null").count() == 1
    good = df.where("_corrupt_record is null")
    assert {r[0]: r[1] for r in T.status_histogram(good).collect()} == {200: 4, 503: 1}
    assert T.throttles(good).first()[0] == 1 and T.latency(good).first()["max_ms"] == 50
    assert T.error_samples(good).count() == 1 and T.presence(good).first()["start_after"] == 0


def test_trace_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.jsonl").write_text("\n".join(map(json.dumps, trace_lines())))
    stream = trace_stream.read_stream(spark, str(tmp_path / "in"))
    assert stream.schema == TRACE
    q = trace_stream.write_windows(trace_stream.windowed_counts(stream, late="1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert (rows[0]["calls"], rows[0]["failed"], rows[0]["max_ms"]) == (2, 1, 50)
