import random

import llm_brute as B
import numpy as np
import pytest

import corpus_pipeline as C
from stocktake.llm import jaccard, simhash


def shingles(text):
    w = B.raw(text).lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """The row with the smallest id of each component, of all pairs with a Jaccard similarity of 0.8."""
    sets, u = [shingles(t) for _, t in rows], B.Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                u.join(j, i)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(u.find(i), []).append(r)
    return sorted(min(g) for g in groups.values())


def near(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, sf).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def edited(rng, words, share):
    out = list(words)
    cut = rng.randrange(len(out))
    n = int(share * len(out))
    return (out[:cut] + [f"e{rng.random()}" for _ in range(n)] + out[cut + n :])[: len(out)]


def test_pairs_around_the_limit(spark, sf):
    rng, rows = random.Random(11), []
    for i in range(300):
        base = [f"w{rng.random()}" for _ in range(rng.randint(60, 300))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, rng.uniform(0.05, 0.16))))]
    want = kept(rows)
    assert 350 < len(want) < 550
    assert near(spark, sf, rows) == want


@pytest.mark.parametrize("small", [256, 5])
def test_large_groups(spark, sf, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng, rows = random.Random(12), []
    base = [f"w{i}" for i in range(200)]
    families = [edited(rng, base, 0.13) for _ in range(6)]
    for i in range(150):
        rows.append((i, " ".join(edited(rng, rng.choice(families), rng.uniform(0.02, 0.1)))))
    want = kept(rows)
    assert len(want) > 1
    assert near(spark, sf, rows) == want


def test_recall_at_the_limit():
    """Of pairs at a similarity of 0.8 to 0.82, with sets of 20 to 400 shingles, candidates are found as planned."""
    rng = np.random.default_rng(3)
    n, met, past = 400, 0, 0
    size = jaccard.words_for(250_000)
    sample = rng.integers(0, 2**63, (512, size)).view(np.uint64)
    plan = simhash.make_plan(sample, 250_000, simhash.Alike(jaccard.APART, jaccard.MISS))
    for _ in range(n):
        m = int(rng.integers(20, 400))
        both, own = -(-8 * m // 9), m - -(-8 * m // 9)
        h = rng.integers(0, 2**63, both + 2 * own).astype(np.uint64) * np.uint64(2)
        sets = [np.append(h[:both], h[both : both + own]), np.append(h[:both], h[both + own :])]
        assert jaccard.similar(np.sort(sets[0]), np.sort(sets[1]))
        f = np.array([simhash.fingerprint(x, size) for x in sets], np.int64)
        a, b = ({k for _, key in simhash.probes(plan, f[i : i + 1].view(np.uint64)) for k in key.tolist()} for i in (0, 1))
        met += bool(a & b)
        rows = np.array([[0, i, m, *f[i][:2]] for i in (0, 1)])
        past += bool(jaccard.near(rows, np.array([0]), np.array([1]))[0])
    assert met >= 0.975 * n and past >= 0.99 * n


def test_similar_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert jaccard.similar(a[:8], np.append(a[:8], [20, 21]).astype(np.uint64))
    assert not jaccard.similar(a[:8], np.append(a[:8], [20, 21, 22]).astype(np.uint64))


def test_rows_are_linked_by_texts_alone(spark, sf):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.random()}" for _ in range(80)) for _ in range(40)]
    rows = [(None, t) for t in texts[:15]] + [(7, t) for t in texts[15:30]] + [(100 + i, t) for i, t in enumerate(texts[30:])]
    rows += [(200, texts[0]), (201, texts[20]), (None, texts[35])]
    got = near(spark, sf, rows)
    assert sorted(got, key=str) == sorted([(None, t) for t in texts[:15]] + [(7, t) for t in texts[15:30]] + [(None, texts[35])] + [(100 + i, t) for i, t in enumerate(texts[30:]) if i != 5], key=str)


def test_unlike_texts_of_large_buckets_are_not_dealt(spark, sf, monkeypatch):
    """Buckets that are large by chance and share a node with the next: only nodes with a candidate get their sets dealt."""
    rng, dealt = np.random.default_rng(14), []
    stash = jaccard.stash

    def spy(df, name="part", *more):
        out = stash(df, name, *more)
        if name == "there":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stash", spy)
    sets = [np.unique(rng.integers(0, 2**63, 30).astype(np.uint64) * np.uint64(2)) for _ in range(1201)]
    sets[700] = np.sort(np.append(sets[650][:-1], np.uint64(1)))
    f = [simhash.fingerprint(s, 4) for s in sets]
    large = [(k, i, 30, *f[i][:2], i) for k in range(4) for i in range(300 * k, 300 * k + 301)]
    large = spark.createDataFrame(large, "key long, node long, n long, f0 long, f1 long, component long")
    nodes = spark.createDataFrame([(i, 30, x) for i, x in enumerate(f)], "node long, n long, f array<long>")
    whole = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, hashes binary")
    assert [tuple(r) for r in jaccard.group_links(large, nodes, whole, 4).collect()] == [(700, 650)]
    assert dealt == [2]


def test_sizes_that_cannot_be_alike():
    sizes = np.arange(1, 60)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(59), np.arange(59)))
    most = [max((both / (x + y - both) for both in range(1, min(x, y) + 1) if both < max(x, y)), default=0) for x, y in zip(sizes[a], sizes[b])]
    assert (jaccard.fitting(sizes, a, b) == (np.array(most) >= 0.8 - 1e-12)).all()
    assert not jaccard.fitting(sizes, a, b)[np.minimum(sizes[a], sizes[b]) < jaccard.SMALLEST].any()


def test_small_sets(spark, sf):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(400)]
    assert near(spark, sf, rows) == kept(rows)
