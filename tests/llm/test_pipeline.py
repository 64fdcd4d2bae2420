import llm_brute as B
import pytest
from test_jaccard import kept

import corpus_pipeline as C
from stocktake.llm import packing


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    from stocktake.llm.common import stash

    for _, stage in C.STAGES:
        out.append(stash(stage(spark, out[-1], sf)))
    return out


def table(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(spark, sf, stages):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert C.run(spark, sf).count() == stages[-1].count() == stages[-2].count()


def test_quality_keeps_good_documents(spark, sf, stages):
    kept = set(table(stages[1]))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_line_stage(stages):
    before, after = table(stages[1]), table(stages[2])
    assert after == {d: x[2] for d, x in B.lines(list(before.items())).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicate_stage(stages):
    before, after = table(stages[2]), table(stages[3])
    assert sorted(after.items()) == kept(list(before.items()))


def test_suffix_stage(stages):
    before, after = table(stages[3]), table(stages[4])
    want = B.substring(list(before.items()))
    rows = sorted(before.items())
    texts = [B.raw(t) for _, t in rows]
    for (d, _), s, c in zip(rows, texts, B.covered(texts, 100)):
        # characters that a removed span cuts stay
        chars, i = [], 0
        for ch in s.decode():
            n = len(ch.encode())
            if not all(c[i : i + n]):
                chars.append(ch)
            i += n
        assert after[d] == "".join(chars), (d, want[d])


def test_packing_stage(stages):
    rows = stages[5].collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(B.raw(t).split()) for d, t in table(stages[4]).items()}
    per = {}
    for r in rows:
        per.setdefault((r["bucket"], r["batch"]), []).append(r)
    for own in per.values():
        assert len(own) == 1 or len(own) * own[0]["bucket_len"] <= packing.BUDGET


def test_odd_documents(spark, sf, odd_docs):
    docs = odd_docs
    for name, stage in C.STAGES[1:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == odd_docs.columns, name
        docs = new
    left = docs.collect()
    assert {r["row"] for r in left} == {"z"} and 0 < len(left) < odd_docs.count()
    assert C.STAGES[0][1](spark, odd_docs, sf).columns == odd_docs.columns
    assert C.STAGES[-1][1](spark, docs, sf).count() == len(left)


def test_empty(spark, sf, no_docs):
    docs = no_docs
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
