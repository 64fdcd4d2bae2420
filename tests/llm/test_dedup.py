import random
import tracemalloc

import llm_brute as B
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocktake.llm import exact_dedup, fm_dedup, line_dedup, passages, registry, repeats, simhash, suffix_dedup
from stocktake.llm.anchors import segments
from stocktake.llm.common import doc_keys
from stocktake.llm.components import connected_components
from stocktake.llm.fuse import FuseFilter
from stocktake.llm.passages import ByteView, WordView
from stocktake.llm.suffix import induced_sort


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def noisy(seed, n=60, alphabet="ab \n"):
    """Texts that share pieces of many sizes."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 400))) for _ in range(8)]
    out = []
    for i in range(n):
        t = "".join(p[rng.randint(0, len(p) - 1) :] for p in rng.sample(pool, 3))
        out.append((i, rng.choice([t, t, None, "", t + t])))
    return out


# --- op2 ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([2, 5, 100]), st.sampled_from([1 << 26, 48]))
def test_induced_sort(symbols, cap, memory):
    t = np.array([*symbols, 0], np.int32)
    sa, lcp = induced_sort(t, 4, cap, memory)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want
    for a, b, k in zip(want, want[1:], lcp[1:]):
        same = next((x for x in range(cap) if max(a, b) + x >= len(t) or t[a + x] != t[b + x]), cap)
        assert k == same


def test_segments_hold_equal_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.array([0, 1000, 1007, 3000])
    by: dict = {}
    heavy = np.zeros(0, np.uint64)
    for _ in range(2):
        doc, a, b, anchor, dig = segments(h, starts, 12, 5, heavy)
        windows, digs = {}, {}
        for d, s, e, k, x in zip(doc, a, b, anchor, dig):
            assert digs.setdefault(h[starts[d] + s : starts[d] + e].tobytes(), x) == x
            for i in range(s, e - 11):
                windows[d, i] = k
        assert len(windows) == sum(max(0, n - 11) for n in (1000, 7, 1993)) and len(set(digs.values())) == len(digs)
        by = {}
        for (d, i), k in windows.items():
            w = h[starts[d] + i : starts[d] + i + 12].tobytes()
            assert by.setdefault(w, k) == k
        heavy = np.unique(anchor)[::3]  # once more, with the windows of some anchors dealt by themselves


def test_sorts_beyond_memory():
    """What the sorter and both finders hold themselves follows ``memory``; a shard may be many times larger."""
    rng = random.Random(3)
    pool = [bytes(rng.choices(b"abcdefgh  ", k=300)) for _ in range(60)]
    contents = [p[a : a + rng.randint(110, 150)] for p in rng.choices(pool, k=9000) for a in [rng.randint(0, 140)]]
    raw, sizes = np.frombuffer(b"".join(contents), np.uint8), np.array([len(c) for c in contents])
    places = np.arange(len(sizes)) << 20
    memory = 1 << 16
    assert len(raw) > 17 * memory
    tracemalloc.start()
    t = np.append(raw.astype(np.int16) + 1, 0)
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    induced_sort(t, 258, 100, memory)
    held = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert held < 24 * memory < 2 * len(raw)
    for find, length in ((suffix_dedup.repeated_windows, 100), (fm_dedup.repeated_windows, 5)):
        if length == 5:
            contents = [b" ".join(c[:120].split()) for c in contents[:1500]]
            raw, sizes, places = np.frombuffer(b"".join(contents), np.uint8), np.array([len(c) for c in contents]), places[:1500]
        small, large = (tuple(x[np.lexsort(got)].tolist() for x in got) for got in (find(raw, sizes, places, length, m) for m in (memory, 1 << 26)))
        want = B.covered_windows([c if length == 100 else c.split(b" ") for c in contents], length)
        assert small == large and sorted(zip(*small)) == want


@pytest.mark.parametrize("length", [100, 12])
def test_suffix_dedup_brute_force(spark, length):
    rows = noisy(length)
    out = suffix_dedup.suffix_dedup(docs_of(spark, rows), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(out) == B.substring(rows, length)


@pytest.mark.parametrize("heavy", [3, 10**6])
def test_heavy_anchors(spark, monkeypatch, heavy):
    monkeypatch.setattr(passages, "SHARD_BYTES", 300)
    monkeypatch.setattr(passages, "RANGE_SEGMENTS", 20)
    monkeypatch.setattr(passages, "SEEN", 3)
    monkeypatch.setattr(passages, "HEAVY", heavy)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, base[: rng.randint(100, 300)] + rng.choice("xyz") + base[rng.randint(100, 250) :]) for i in range(60)]
    out = suffix_dedup.suffix_dedup(docs_of(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(out) == B.substring(rows)
    words = [(i, " ".join(t)) for i, t in rows]
    out = fm_dedup.fm_dedup(docs_of(spark, words)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(out) == B.word_windows(words)


def test_op2_query(spark, sf, docs_rows):
    assert got(registry.QUERIES["op2_suffix_dedup"](spark, sf)) == B.substring(docs_rows)


def test_whole_characters():
    raw = "aßßb".encode()
    assert suffix_dedup.whole_characters(raw, [(2, 4)]) == [] and suffix_dedup.whole_characters(raw, [(1, 5)]) == [(1, 5)]


# --- op3 ---


@pytest.mark.parametrize("length", [20, 4])
def test_fm_dedup_brute_force(spark, length):
    rng = random.Random(length)
    pool = [[rng.choice("a b c dd é".split()) for _ in range(rng.randint(5, 80))] for _ in range(6)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(sum((p[rng.randint(0, 4) :] for p in rng.sample(pool, 3)), []))) for i in range(50)] + [(50, None), (51, "")]
    out = fm_dedup.fm_dedup(docs_of(spark, rows), length).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(out) == B.word_windows(rows, length)


def test_op3_query(spark, sf, docs_rows):
    assert got(registry.QUERIES["op3_fm_dedup"](spark, sf)) == B.word_windows(docs_rows)


def test_bits():
    bit = np.random.default_rng(2).random(1000) < 0.3
    bits, at = fm_dedup.Bits(bit), np.arange(1001)
    assert bits.rank(at).tolist() == np.append(0, np.cumsum(bit)).tolist()
    assert bits.select(np.arange(bits.total)).tolist() == np.flatnonzero(bit).tolist()


def test_index_is_compressed_and_locates():
    rng = np.random.default_rng(3)
    t = np.append(rng.integers(1, 60, 20_000), 0).astype(np.int32)
    index = fm_dedup.FmIndex(t, 60, 4)
    sa, lcp = induced_sort(t, 60, 4)
    rows = rng.integers(0, len(t), 500)
    assert index.locate(rows).tolist() == sa[rows].tolist()
    low, high = index.shorten(rows)
    head = np.append(np.flatnonzero(lcp < 3), len(t))
    at = np.searchsorted(head, rows, "right")
    assert low.tolist() == head[at - 1].tolist() and high.tolist() == head[at].tolist()
    vectors = [*index.tree.levels, index.apart, index.sampled]
    size = sum(b.words.nbytes + b.counts.nbytes for b in vectors) + index.places.nbytes + index.first.nbytes
    assert size < 3 * len(t)  # 6 bits of a symbol, two marks, counts, and an eighth of the places


def test_wavelet_tree_ranks():
    s = np.random.default_rng(0).integers(0, 37, 500)
    tree = fm_dedup.WaveletTree(s, 37)
    symbol, before = tree.symbol_and_rank(np.arange(500))
    assert symbol.tolist() == s.tolist() and before.tolist() == [int((s[:i] == s[i]).sum()) for i in range(500)]
    for c in (0, 5, 36):
        i = np.arange(0, 501, 7)
        assert tree.rank(np.full(len(i), c), i).tolist() == [int((s[:k] == c).sum()) for k in i]


# --- op7 ---


def test_line_dedup_brute_force(spark):
    rng = random.Random(2)
    pool = ["A line of Twenty chars!", "short", "", "  padded line of text here \t", "ÄÖÜ ß and more than twenty", "exactly twenty chars", "a line of twenty chars!"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(40, None)]
    out = line_dedup.line_dedup(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", "text")
    assert got(out) == B.lines(rows)


def test_lines_count_documents(spark):
    """Rows that repeat an id count once; rows without one are one document, the smallest."""
    line, other, third = "a line of more than twenty", "another line of that length", "third line, of that length"
    rows = [(1, line), (1, line), (2, line), (3, other + "\nx"), (4, other), (None, other), (None, other), (5, third), (6, third), (6, "y\n" + third), (7, third)]
    out = line_dedup.line_dedup(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = [(1, 1, 0, line), (1, 1, 0, line), (2, 1, 0, line), (3, 2, 1, "x"), (4, 1, 0, other), (None, 1, 1, ""), (None, 1, 1, ""), (5, 1, 1, ""), (6, 1, 1, ""), (6, 2, 1, "y"), (7, 1, 0, third)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [2000, 4000, 8000])
def test_filters_keep_up(spark, monkeypatch, n):
    """No repeat is missed, and the share of single hashes that pass stays level as the input grows."""
    monkeypatch.setattr(repeats, "RANGE_HASHES", 64)
    rows = [(i, str(i if i < n else i - n)) for i in range(n + n // 10)]

    def hashes(text):
        return np.array([int(text) * 0x9E3779B97F4A7C15 % 2**64], np.uint64)

    found = repeats.suspects(doc_keys(docs_of(spark, rows)), hashes, n).collect()
    got = [r["did"] for r in found]
    twice = {i for i in range(n // 10)} | {i for i in range(n, n + n // 10)}
    assert twice <= set(got) and len(got) == len(set(got))
    assert len(set(got) - twice) < 0.06 * n


# --- op8 ---


def test_simhash_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, rng.choice(base) + rng.choice(["", " x", " Y y", ""])) for i in range(120)] + [(120, None), (121, " ")]
    for words, distance in ((3, 3), (2, 12)):
        prints = {d: B.simhash(t, words) for d, t in rows}
        comps = B.components(prints, lambda a, m, k=distance: np.bitwise_count(m[:, 0] ^ a[0]) <= k)
        out = simhash.simhash_components(docs_of(spark, rows), words, distance).select("doc_id", "f0", "component").collect()
        assert {r[0]: (r[1] % 2**64, r[2]) for r in out} == {d: (prints[d], comps[d]) for d, _ in rows}


def test_op8_query(spark, sf, docs_rows):
    prints = {d: B.simhash(t) for d, t in docs_rows}
    comps = B.components(prints, lambda a, m: np.bitwise_count(m[:, 0] ^ a[0]) <= 3)
    assert got(registry.QUERIES["op8_simhash"](spark, sf)) == {d: (f"{prints[d]:016x}", comps[d]) for d in prints}


@pytest.mark.parametrize("distance", [0, 3, 7, 13])
@pytest.mark.parametrize("n", [10, 10**5, 10**9])
def test_plans_cover_the_distance(n, distance):
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 2**64, (200, 1), dtype=np.uint64)
    plan = simhash.make_plan(sample, n, simhash.Within(distance))
    places = [b for p in plan.parts for b in p]
    assert len(places) == len(set(places))
    for _ in range(300):
        flip = set(rng.choice(64, distance, replace=False).tolist())
        assert any(len(flip & set(p)) <= t for p, t in zip(plan.parts, plan.thresholds))
    # probes meet within the threshold of a part
    f = np.append(sample[:1], sample[:1] ^ np.uint64(sum(1 << b for b in flip)), axis=0)
    mine, other = ({k for _, key in simhash.probes(plan, f[i : i + 1]) for k in key.tolist()} for i in (0, 1))
    assert mine & other


def test_correlated_bits_share_a_part():
    bits = np.random.default_rng(6).random((500, 8)) < 0.5
    parts = simhash.group_bits(np.repeat(bits, 8, axis=1).astype(float), 8)
    assert sorted(map(tuple, parts)) == [tuple(range(i, i + 8)) for i in range(0, 64, 8)]


def near_in(distance):
    return lambda rows, a, b: np.bitwise_count((rows[a, 1] ^ rows[b, 1]).view(np.uint64)) <= distance


@pytest.mark.parametrize("small,block", [(48, 4096), (3, 7)])
def test_large_buckets_keep_their_components(spark, monkeypatch, small, block):
    """One bucket with a third of all rows, in blocks: the same components as all pairs give."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    centers = [rng.getrandbits(63) for _ in range(6)]
    nodes = sorted({c ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for c in centers for _ in range(30)} | {rng.getrandbits(63) for _ in range(40)})
    rows = [(0, f) for f in nodes] + [(1 + i // 2, rng.getrandbits(63)) for i in range(2 * len(nodes))]
    posted = spark.createDataFrame(rows, "key long, node long").repartition(3)
    got_links, want = B.Union(), B.Union()
    for r in simhash.posted_links(posted, near_in(2)).collect():
        got_links.join(r["u"], r["v"])
    for key in {k for k, _ in rows}:
        own = [f for k, f in rows if k == key]
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a ^ b).bit_count() <= 2:
                    want.join(a, b)
    assert all(got_links.find(f) == want.find(f) for _, f in rows)
    assert len({want.find(f) for f in nodes}) > 10


def test_ids_and_links(spark):
    """Rows of one id are one document; rows without an id are linked by their texts alone and name no component."""
    far = ["alpha beta gamma delta", "one two three four five", "x y z", "red green blue black"]
    rows = [(5, far[0]), (5, far[1]), (9, far[1]), (None, far[2]), (None, far[3]), (7, far[3]), (-(2**63), "min of all ids")]
    out = simhash.simhash_components(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["component"]) for r in out), key=str) == sorted([(5, 5), (5, 5), (9, 5), (None, None), (None, 7), (7, 7), (-(2**63), -(2**63))], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    out = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys([200, *range(201, 251)], 200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op9 ---


def test_exact_dedup_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a  b", "a b", "a\tb", "a b ", "", " ", None, "c", "d\n\ne", "d e", f"own {i}"])) for i in range(90)]
    batches = [docs_of(spark, rows[:30]), docs_of(spark, rows[30:70]), docs_of(spark, rows[70:])]
    assert got(exact_dedup.exact_dedup(batches)) == B.exact(rows)
    # digests of one byte collide: whole texts decide
    weak = exact_dedup.exact_dedup(batches, lambda s: F.substring(s, 1, 1))
    rows2 = [(i, f"text {i % 400}") for i in range(600)]
    assert got(weak) == B.exact(rows)
    assert got(exact_dedup.exact_dedup([docs_of(spark, rows2[:200]), docs_of(spark, rows2[200:])], lambda s: F.substring(s, 1, 1))) == B.exact(rows2)


def test_fuse_filter():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 10, 1000, 20000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        f = FuseFilter.build(np.concatenate([keys, keys]))
        assert f.maybe(keys).all()
        assert f.maybe(rng.integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.02


# --- odd and empty tables ---

RUNS = {
    "op2": suffix_dedup.suffix_dedup,
    "op3": fm_dedup.fm_dedup,
    "op7": line_dedup.line_dedup,
    "op8": simhash.simhash_components,
    "op9": lambda d: exact_dedup.exact_dedup([d]),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(spark, odd_docs, no_docs, name):
    assert RUNS[name](odd_docs).count() == odd_docs.count()
    assert RUNS[name](no_docs).count() == 0


def test_defined_results(odd_docs):
    two = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.suffix_dedup(odd_docs).collect()}
    size = len(" ".join(f"word{i}" for i in range(60)))
    assert two[5, size + 5] == size and two[None, 20] == 0 and two[1, 0] == 0
    assert sorted([two[4, size], two[4, size + 8]])[0] == 0  # one id, two texts: one of them comes first
    exact = exact_dedup.exact_dedup([odd_docs]).where("doc_id = 4").collect()
    assert sorted(r["group_size"] for r in exact) == [1, 2, 2] and all(r["kept"] for r in exact)
    empty = exact_dedup.exact_dedup([odd_docs]).where("doc_id in (1, 2, 8)").collect()
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(1, 3)}
    near = {(r["doc_id"], r["component"]) for r in simhash.simhash_components(odd_docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (8, 1)} <= near


def test_repeated_and_missing_ids(spark):
    """op2 and op3 by value: rows that repeat id and text are one document; others of one id, or without, are documents."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, words), (1, words + " tail"), (None, "head " + words), (-(2**63), words), (2, None), (2, "short")]
    docs = docs_of(spark, rows)
    n = len(words)
    two = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()}
    three = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in fm_dedup.fm_dedup(docs).collect()}
    # no id comes with the smallest id there is; which of the two is first is by a hash
    first = two[None, n + 5] == 0
    assert two[None, n + 5] == (0 if first else n) and two[-(2**63), n] == (n if first else 0)
    assert two[1, n] == n and two[1, n + 5] == n and two[2, 0] == 0 and two[2, 5] == 0
    assert three[1, 40] == 40 and three[1, 41] == 40 and three[2, 0] == 0 and three[2, 1] == 0
    assert sorted((three[None, 41], three[-(2**63), 40])) == [0, 40]
    assert suffix_dedup.suffix_dedup(docs).count() == len(rows) == fm_dedup.fm_dedup(docs).count()


def test_views_handle_tiny_and_long():
    for view in (ByteView(100, 40), WordView(20, 12)):
        assert sum(len(f[0]) for f in view.segments([b"", b" ", b"x"])) == 0
        long = b"".join(b"%d " % (i * 7919 % 100003) for i in range(400000))
        n = sum(int((e - s - view.length + 1).sum()) for _, s, e, *_ in view.segments([long]))
        assert n == (len(long) if isinstance(view, ByteView) else 400000) - view.length + 1
