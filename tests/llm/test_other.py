import random
import zlib

import llm_brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stocktake.llm import bpe, packing, quality, registry, topk, url_filter


# --- op1 ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist(), 0) for i in range(700)]
    rows += [(700 + i, rows[100][1], 0) for i in range(20)]  # ties
    rows += [(800, None, 0), (801, [1.0, None] * 3, 0), (900, [float("nan")] * 6, 0), (901, [float("inf")] * 6, 0)]
    df = vectors(spark, rows)
    out = topk.top_k(df, df.where("vec_id % 100 = 0"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(B.top([(i, v) for i, v, _ in rows]))


def test_top_k_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 2 * 8 * 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(500)]
    df = vectors(spark, rows)
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()) == sorted(B.top([(i, v) for i, v, _ in rows]))


def test_top_k_odd(spark):
    rows = [(0, [1e300, 1.0], 0), (100, [2.0], 0), (1, [], 0), (2, [3.0, 4.0], 0), (2, [3.0, 4.0], 0), (3, [-1e300, 0.0], 0)]
    df = vectors(spark, rows)
    out = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    assert out[100, 2] == 2048 * 3072 and out[0, 3] == -(2**63 - 1) and out[0, 100] == 2**63 - 1 and out[100, 1] == 0
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df, df.where("false")).count() == 0


def test_op1_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in registry.QUERIES["op1_topk"](spark, sf).collect()) == sorted(B.top(rows))


def test_threshold_prunes():
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(12, 4000)) * 1000 / np.arange(1, 13)[:, None] ** 2).astype(np.int64)
    for i in range(20):
        q = m[:, i]
        want = sorted((-int(q @ m[:, j]), j) for j in range(4000))[:7]
        found, scores, probed = topk.max_score(m, np.arange(4000), q, 7, m.min(axis=1), m.max(axis=1))
        assert [(-int(s), int(j)) for j, s in zip(found, scores)] == want
        # a threshold known before leaves the less to probe
        again, scores, fewer = topk.max_score(m, np.arange(4000), q, 7, m.min(axis=1), m.max(axis=1), -want[-1][0])
        assert [(-int(s), int(j)) for j, s in zip(again, scores)] == want
        assert fewer <= probed < 0.7 * m.size


def test_candidates_are_rows(spark):
    """Repeated ids, vectors or both each count, but for one row like the query's own; other columns may have any name."""
    rows = [(0, [1.0, 2.0], "x")] * 3 + [(0, [2.0, 2.0], "x"), (5, [1.0, 2.0], "x"), (5, [1.0, 2.0], "x"), (None, [9.0, 9.0], "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string").selectExpr("*", *[f"q AS {c}" for c in ("v", "key", "floor", "score", "like", "rank", "shard")]).repartition(2)
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 0"), 4).collect())
    a, b, c = (1024 * 1024 * x for x in (5, 6, 8))
    # of the three equal rows each sees two like itself
    want = 3 * [(0, 1, 0, b), (0, 2, 0, a), (0, 3, 0, a), (0, 4, 5, a)] + [(0, 1, 0, b), (0, 2, 0, b), (0, 3, 0, b), (0, 4, 5, b)]
    assert c and out == sorted(want)


# --- op4 ---


def test_bpe_like_the_library(docs_rows):
    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.load(bpe.vocabulary_path())
    texts = [t for _, t in docs_rows if t] + ["", " ", "It's <|endoftext|>x 12ab don't '''s", "<|startoftext|><|endoftext|>", "a" * 3000, "日本語 🎉🎉", "ΣΑΣ İI ½²"]
    rng = random.Random(4)
    pool = "aB 1'sé\n\t\x1f<|>½🎉आ-_.,Σ" + "".join(map(chr, (0x85, 0xA0, 0x301, 0x3000, 0x2003, 0x200B)))
    texts += ["".join(rng.choice(pool) for _ in range(50)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.both(t)[1].decode() == library.decode(want, skip_special_tokens=False)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_op4_query(spark, sf, docs_rows, odd_docs, no_docs):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r[0]: tuple(r[1:]) for r in registry.QUERIES["op4_bpe"](spark, sf).collect()}
    for d, t in docs_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), B.sha(" ".join(map(str, ids)).encode()), B.sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert bpe.bpe_digests(odd_docs).count() == odd_docs.count() and bpe.bpe_digests(no_docs).count() == 0
    assert bpe.bpe_encode(odd_docs).where("doc_id = 1").first()["ids"] == []


# --- op5 ---


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        k = rng.randint(1, 5)
        counts = sorted((x, lengths.count(x)) for x in set(lengths))
        bounds = packing.optimal_bounds([x for x, _ in counts], [c for _, c in counts], k)
        assert len(bounds) <= k and bounds == sorted(set(bounds))
        assert sum(next(b for b in bounds if b >= x) - x for x in lengths) == B.best_padding(lengths, k)


def test_packing_brute_force(spark, sf, docs_rows):
    rows = registry.QUERIES["op5_packing"](spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(B.raw(t).split()) for d, t in docs_rows}
    counts = sorted((x, sum(r["n_tokens"] == x for r in rows)) for x in {r["n_tokens"] for r in rows})
    bounds = packing.optimal_bounds([x for x, _ in counts], [c for _, c in counts], packing.BUCKETS)
    for b, bound in enumerate(bounds):
        own = sorted((r for r in rows if r["bucket"] == b), key=lambda r: r["doc_id"])
        fit = max(1, packing.BUDGET // max(bound, 1))
        for i, r in enumerate(own):
            assert (r["bucket_len"], r["batch"], r["slot"], r["padding"]) == (bound, i // fit, i % fit, bound - r["n_tokens"])
    assert len({r["bucket"] for r in rows}) == len(bounds)


def test_packing_odd(odd_docs, no_docs):
    rows = packing.pack(odd_docs, buckets=3, budget=100).collect()
    assert len(rows) == odd_docs.count() and len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {0}
    assert packing.pack(no_docs).count() == 0


def test_packing_of_repeated_ids(spark):
    rows = [(None, "a b")] * 3 + [(1, "x y z"), (1, "x y z"), (1, "p q")] + [(2, None), (2, "one")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=2, budget=6).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=str) == sorted([(None, 2)] * 3 + [(1, 3), (1, 3), (1, 2), (2, 0), (2, 1)], key=str)
    for bucket in {r["bucket"] for r in out}:
        own = sorted((r for r in out if r["bucket"] == bucket), key=lambda r: (r["batch"], r["slot"]))
        ids = [r["doc_id"] for r in own]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))  # no id first, then by id
        fit = max(1, 6 // max(own[0]["bucket_len"], 1))
        assert [(r["batch"], r["slot"]) for r in own] == [(i // fit, i % fit) for i in range(len(own))]
    assert sum(r["padding"] for r in out) == B.best_padding([2, 2, 2, 3, 3, 2, 0, 1], 2)


def test_packing_with_a_very_long_text(spark):
    rng = random.Random(6)
    lengths = [rng.randint(1, 400) for _ in range(60)] + [200_001]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=3).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(lengths))
    assert sum(r["padding"] for r in rows) == B.best_padding(lengths, 3)
    assert {r["bucket_len"] for r in rows} <= set(lengths)


# --- op6 ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [(1, "http://A.Example.com/en/x", None), (2, "https://www.example.com/en/y?q", None), (3, "x://example.net/es/", ""), (4, "http://other.org/", ""), (5, None, None), (6, "nonsense", "x"), (7, "http://com/", ""), (8, "http://xcom", ""), (9, "http://b.net#f/es/", ""), (10, "", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages(spark, rows)).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/y", "www.example.com/en/", "allow"), 3: ("example.net", "/es/", "net/es/", "block"),
        4: ("other.org", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "/", "com/", "allow"), 8: ("xcom", "", None, "allow"), 9: ("b.net", "", None, "allow"), 10: ("", "", None, "allow"),
    }


def test_aliases(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://mirror.org/a", link.format("https://bad.net/es/page")), (2, "http://mirror.org/b", '<meta http-equiv="refresh" content="0; url=/a">'),
        (3, "http://copy.org/x", link.format("//bad.net/fr/1")), (4, "http://copy.org/y", link.format("http://copy.org/x")), (5, "http://copy.org/z", link.format("http://fine.com/")), (6, "http://copy.org/w", link.format("z")),
        (7, "http://copy.org/w2", None), (8, "http://fine.com/", "<p>"), (9, "http://copy.org/v", link.format("http://bad.net/es/2")), (10, "http://old.org/", ""),
    ]
    redirects = spark.createDataFrame([("http://copy.org/v", "http://copy.org/z"), ("http://old.org", "http://mirror.org/b"), (None, "x")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages(spark, rows), redirects=redirects).collect()}
    # 9 is an alias of a blocked url and, over 5, of an allowed one: the explicit allow wins
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block"}


def test_url_filter_empty_and_repeated(spark):
    assert url_filter.url_filter(pages(spark, []).withColumn("verdict", F.lit(1))).count() == 0
    assert url_filter.url_filter(pages(spark, [(1, "http://x.net/es/", None)] * 3)).where("verdict = 'block'").count() == 3


def test_url_filter_is_native(spark, sf):
    df = registry.QUERIES["op6_url_filter"](spark, sf)
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


# --- op10 ---


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scores = registry.QUERIES["op10_quality"](spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scores.join(truth, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(rows) > 40
    for label in (0, 1):
        own = [r["predicted"] == label for r in rows if r["quality"] == label]
        assert sum(own) / len(own) >= 0.85


def test_quality_reads_no_held_out_label(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r[0]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 0, 0), (7, 1, 1), (None, 1, 1), (9, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    none = quality.quality_scores(odd_docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = quality.quality_scores(odd_docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in ones} == {1.0}
    assert quality.quality_scores(no_docs, labels).count() == 0


def test_fit_brute_force(spark):
    """Means, shrunk covariances and scores of the model, from all training rows at once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] is not None}
    x, y = np.array([quality.statistics(texts[d]) for d in marks]), np.array(list(marks.values()))
    model = quality.train(docs, labels)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    dens = []
    everything = np.array([quality.statistics(t) for t in texts.values()])
    for k in (0, 1):
        assert np.allclose(model.means[k], x[y == k].mean(axis=0))
        c = 0.9 * covs[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.diag(c)) + np.diag(1e-3 + 1e-3 * (np.diag(pooled) + 1e-3))
        assert np.allclose(model.factors[k] @ model.factors[k].T, c)
        z = everything - x[y == k].mean(axis=0)
        dens.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    want = dict(zip(texts, 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert abs(r["score"] - want[d]) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r["predicted"]}


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"{'good text ' * (i % 7 + 1)}{'!' * (i % 5)} {i}") for i in range(60)], "doc_id long, text string")
    once = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    more = once.union(once.where("doc_id % 3 = 0")).union(spark.createDataFrame([(4, 1, 0)], once.schema))
    a, b = quality.train(docs, once), quality.train(docs, more)
    assert all(np.allclose(x, y) for x, y in zip(a.means + a.factors, b.means + b.factors))


def test_factors_give_log_densities():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T + np.eye(5)
    m = quality.Discriminant([np.zeros(5)] * 2, [np.linalg.cholesky(cov)] * 2, [0.0, 0.0])
    x = rng.normal(size=(7, 5))
    want = -0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x)
    assert np.allclose(m.log_density(x, 0), want)


def test_statistics_are_whole_text():
    assert quality.statistics("") == quality.statistics(" \n") == [0.0] * quality.FEATURES
    assert len(quality.statistics("Some words, here!")) == quality.FEATURES


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered(name):
    assert name.startswith("op") and callable(registry.QUERIES[name])
