from pyspark.sql import functions as F

from stocktake.functions import etag, keys


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "k string").select(col(F.col("k")).alias("v")).first()["v"]


def test_prefixes(spark):
    want = {"test.jpg": "/", "a/b/c/test.jpg": "a/b/c", "dir/": "dir", "a//b": "a/", "/leading": "", "//x": "/", "": "/", "ä/ö.txt": "ä"}
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", keys.prefix(F.col("k")).alias("p"), keys.name(F.col("k")).alias("n")).collect()
    assert {r["k"]: r["p"] for r in rows} == want
    assert all(r["k"].endswith(r["n"]) for r in rows)


def test_encode_round_trip(spark):
    for k in ("test.jpg", "a/b/c.txt", "dir/", "a//b"):
        assert one(spark, lambda c: keys.encode(keys.prefix(c), keys.name(c)), k) == k


def test_ancestors(spark):
    assert one(spark, keys.ancestors, "big/a/x") == ["big/a/", "big/", ""]
    assert one(spark, keys.ancestors, "x") == [""]


def test_segments(spark):
    rows = spark.createDataFrame([(k,) for k in ("a.txt", "m/", "n.txt", "t/", "u.txt", "z.txt")], "k string")
    got = {r[0]: r[1] for r in rows.select("k", keys.segment_index(F.col("k"), ["m/", "t/"])).collect()}
    assert got == {"a.txt": 0, "m/": 0, "n.txt": 1, "t/": 1, "u.txt": 2, "z.txt": 2}


def test_etags(spark):
    md5 = "0123456789abcdef0123456789ABCDEF"
    low, none = md5.lower(), "0" * 32
    cases = {
        f'"{md5}"': low, f'"{md5}-37"': f"{low}-37", f'"{md5}-10000"': f"{low}-10000", f'"{md5}-4294967295"': f"{low}-4294967295", f'"{md5}-4294967296"': none,
        md5: none, '""': none, '"zz23456789abcdef0123456789abcdef"': none, f'"{md5}-"': none, '"é"': none, f'"{md5}-99999999999999999999"': none,
    }
    for raw, want in cases.items():
        assert one(spark, etag.normalise, raw) == want, raw
    assert spark.createDataFrame([(None,)], "k string").select(etag.normalise(F.col("k"))).first()[0] == none


def test_text(spark):
    assert one(spark, keys.tsv_escape, "a\tb\nc\\d\re") == "a\\tb\\nc\\\\d\\re"
    assert one(spark, keys.csv_quote, 'we"ird') == '"we""ird"'
    assert one(spark, keys.sanitize_path, "a b/c.d-e_é") == "a_b_c.d-e__"
    assert one(spark, keys.sanitize_path, "") == "_"
    rows = spark.createDataFrame([(512,), (1536,), (5 * 2**40,)], "n long").select(keys.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["512 B", "1.50 KiB", "5.00 TiB"]


def test_error_classes(spark):
    rows = spark.createDataFrame([("SlowDown",), ("ThrottlingException",), ("RequestTimeout",), ("Odd",)], "c string").select(keys.error_class(F.col("c")).alias("e")).select("e.*").collect()
    assert [(r["errno"], r["name"], r["retryable"]) for r in rows] == [(21, "SlowDown", False), (22, "TooManyRequests", False), (24, "ServiceUnavailable", False), (255, "Unknown", False)]
