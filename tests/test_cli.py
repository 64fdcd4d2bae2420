import json

import pytest

from stocktake.__main__ import main


@pytest.fixture
def folder(tmp_path):
    for k in ("a/1.txt", "a/2.txt", "b/3.txt"):
        p = tmp_path / "in" / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(k * 10)
    return f"folder:{tmp_path / 'in'}"


def test_list_manifest_and_check(spark, folder, tmp_path, capsys):
    out, report = str(tmp_path / "out"), str(tmp_path / "m.json")
    assert main(["list", folder, "--output-dir", out, "--filter", "SOURCE.size > 10", "--run-manifest", report]) == 0
    assert spark.read.parquet(f"{out}/rows").count() == 3
    assert main(["manifest-summary", report, "--check"]) == 0
    body = json.load(open(report))
    body["metrics"]["parquet_rows"] = 9
    json.dump(body, open(report, "w"))
    assert main(["manifest-summary", report, "--check"]) == 6
    assert main(["manifest-summary", report]) == 0
    assert "objects  3" in capsys.readouterr().out


def test_diff(spark, folder, tmp_path):
    listing = str(tmp_path / "l")
    assert main(["list", folder, "--output-dir", listing, "--prefix", "a/"]) == 0
    assert main(["diff", folder, f"{listing}/rows", "--output-dir", str(tmp_path / "d"), "--filter", "TARGET.size > 0"]) == 0
    rows = {r["Key"]: r["DiffFlag"] for r in spark.read.parquet(str(tmp_path / "d/rows")).collect()}
    assert rows == {"a/1.txt": 0, "a/2.txt": 0, "b/3.txt": 1}


def test_usage_errors_and_plans(folder, tmp_path, capsys):
    out = ["--output-dir", str(tmp_path / "x")]
    assert main(["list", folder, *out, "--filter", "TARGET.size > 1"]) == 2
    assert main(["list", folder, *out, "--start-after", "a", "--resume", "j"]) == 2
    hints = tmp_path / "h"
    hints.write_text("m/\na/\n")
    assert main(["list", folder, *out, "--hints-file", str(hints), "--plan-json"]) == 0
    assert json.loads(capsys.readouterr().out)["segments"] == 3
    assert main(["doctor", "--hints-file", str(hints)]) == 0
    assert json.loads(capsys.readouterr().out)["hints"]["boundaries"] == 2
    (tmp_path / "bad.toml").write_text('profile = "minio"\n')
    assert main(["--config", str(tmp_path / "bad.toml"), "doctor"]) == 3


def test_discovery_cache_and_probes(spark, folder, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    out = ["--output-dir", str(tmp_path / "x")]
    assert main(["discover", folder]) == 0
    assert (tmp_path / "in_hints.toml").exists()
    capsys.readouterr()
    assert main(["list", folder, *out, "--plan-json"]) == 0
    assert json.loads(capsys.readouterr().out)["segments"] == 3
    assert main(["list", folder, *out, "--no-auto-hints", "--plan-json"]) == 0
    assert json.loads(capsys.readouterr().out)["segments"] == 1
    assert main(["list", folder, *out, "--continuation-token", "a/1.txt", "--start-after", "a"]) == 2
    assert main(["list", folder, *out, "--continuation-token", "a/1.txt"]) == 0
    assert sorted(r["Key"] for r in spark.read.parquet(str(tmp_path / "x/rows")).collect()) == ["a/2.txt", "b/3.txt"]
    capsys.readouterr()
    (tmp_path / "p.json").write_text(json.dumps({"endpoint_url": "https://x", "tests": [{"test": "head_bucket", "status": "ok"}, {"test": "list_prefix", "status": "error", "http_status": 403}]}))
    assert main(["compat-probe", str(tmp_path / "p.json")]) == 6
    said = json.loads(capsys.readouterr().out)
    assert said["overall"] == {"https://x": "partial"} and said["errors"][0]["diagnosis"] == "access_denied"


def test_trace_of_a_run(spark, folder, tmp_path):
    from stocktake.operators.trace import by_operation, read_trace

    out, calls = ["--output-dir", str(tmp_path / "x")], str(tmp_path / "calls")
    (tmp_path / "h").write_text("b/\n")
    assert main(["list", folder, *out, "--hints-file", str(tmp_path / "h"), "--trace-compat", calls]) == 0
    assert {r[0]: r[1] for r in by_operation(read_trace(spark, calls)).collect()} == {"ListObjectsV2": 2, "ListObjectsV2SegmentSummary": 2}
    assert main(["list", str(tmp_path / "x/rows"), *out, "--trace-compat", calls]) == 2
    (tmp_path / "file").write_text("")
    assert main(["list", folder, *out, "--trace-compat", str(tmp_path / "file")]) == 5
