import math
import random

import pytest
from pyspark.sql import functions as F

from stocktake.functions.predicate import FilterError, bindings, compile_filter, evaluate, keep_column, total, value_column

GOOD = [
    "SOURCE.size > 1000", "SOURCE.size % 1000 == 24", "-SOURCE.size < 0", "SOURCE.size > 1.5e3", "!(SOURCE.size > 1000)",
    "(SOURCE.size > 1000 || false) && true", "1000/(1-SOURCE.size) > 0", "true || 1", "SOURCE.size == 0 || 1", "(SOURCE.size == 1) == true",
    "SOURCE . size > 1_000", "((SOURCE.size > 1))", "SOURCE.size == 1.0", "SOURCE.last_modified != 3",
]
BAD = [
    "1/SOURCE.size > 0", "true && 1", "SOURCE.size < 2 < 3", "!SOURCE.size > 1", "SOURCE.key > 1", "OTHER.size > 1", "size(SOURCE) > 1", "SOURCE.size", "1 + 1",
    "SOURCE.size >", "SOURCE.size > 1 1", "SOURCE.size & 1", "(((SOURCE.size > 1)))", "(" * 60 + "true" + ")" * 60, "SOURCE.size > 9223372036854775808",
    "SOURCE.size > 'a'", "", "SOURCE.size > 1." , "TARGET.size > 1", "source.size > 1", "true " + "&& true " * 80,
]


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    compile_filter(text)


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(FilterError):
        compile_filter(text)


def test_error_keeps_and_short_circuit():
    tree = compile_filter("1000/(1-SOURCE.size) > 0")
    assert evaluate(tree, {("SOURCE", "size"): 1, ("SOURCE", "last_modified"): 0}) is None
    tree = compile_filter("SOURCE.size == 0 || 1")
    assert evaluate(tree, {("SOURCE", "size"): 5, ("SOURCE", "last_modified"): 0}) is None
    tree = compile_filter("1 / (SOURCE.size - 1) < 5 && false")
    assert evaluate(tree, {("SOURCE", "size"): 1, ("SOURCE", "last_modified"): 0}) is None


def _random(rng, depth=0):
    pick = rng.random()
    if depth > 2 or pick < 0.3:
        return rng.choice(["SOURCE.size", "TARGET.size", "SOURCE.last_modified", "0", "1", "3", "9223372036854775807", "2.5", "0.0", "true", "false"])
    if pick < 0.4:
        return rng.choice("!-+") + _random(rng, depth + 1)
    op = rng.choice(["+", "-", "*", "/", "%", "<", "<=", ">", ">=", "==", "!=", "&&", "||"])
    return f"{_random(rng, depth + 1)} {op} {_random(rng, depth + 1)}"


def test_columns_agree_with_the_interpreter(spark):
    rng = random.Random(5)
    values = [0, 1, 2, 3, 7, 1000, 2**62, 2**63 - 1]
    rows = [(rng.choice(values), rng.choice(values), rng.choice(values), rng.choice(values)) for _ in range(30)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").coalesce(1)
    bind = bindings({"Size": F.col("a"), "LastModified": F.col("b")}, {"Size": F.col("c"), "LastModified": F.col("d")})
    trees = []
    while len(trees) < 120:
        try:
            trees.append(compile_filter(_random(rng), diff=True))
        except FilterError:
            pass
    for lo in range(0, len(trees), 30):
        part = trees[lo : lo + 30]
        got = df.select("*", *[value_column(t, bind).alias(f"v{i}") for i, t in enumerate(part)]).collect()
        for r in got:
            props = {("SOURCE", "size"): r["a"], ("SOURCE", "last_modified"): r["b"], ("TARGET", "size"): r["c"], ("TARGET", "last_modified"): r["d"]}
            for i, t in enumerate(part):
                assert r[f"v{i}"] == evaluate(t, props), (t, props)


def test_float_division_edges(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (5, 2)], "a long, b long")
    bind = bindings({"Size": F.col("a"), "LastModified": F.col("b")})
    for text in ("SOURCE.size / (SOURCE.last_modified * 1.0) > 2.0", "SOURCE.size / -(SOURCE.last_modified * 1.0) < 0.0", "SOURCE.size % (SOURCE.last_modified * 1.0) != 1.0"):
        tree = compile_filter(text)
        for r in df.select("*", value_column(tree, bind).alias("v")).collect():
            assert r["v"] == evaluate(tree, {("SOURCE", "size"): r["a"], ("SOURCE", "last_modified"): r["b"]})
    assert math.isnan(evaluate(compile_filter("0.0 / 0.0 == 1.0").args[0], {}))


def test_total_filters_reach_the_scan(spark, sf):
    tree = compile_filter("SOURCE.size > 100 && !(SOURCE.last_modified < 5)")
    assert total(tree)
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("n_chars").alias("Size"), F.col("doc_id").alias("LastModified"))
    plan = df.where(keep_column(tree, bindings({"Size": F.col("Size"), "LastModified": F.col("LastModified")}), True))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,100)" in plan
    assert not total(compile_filter("SOURCE.size + 1 > 2"))
