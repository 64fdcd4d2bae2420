"""Shared pieces of the training-data operators: tables, work folders, small joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_BYTES = 8 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a table is stashed: what the write has shuffled goes when it has ended, and Python workers get texts in small batches.
STASHING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: "2000"}
#: Stands in for a null id in internal keys; no real id sorts before it. The last bit of a row's hash tells it from a real one.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # local Python workers find this package wherever the session was started
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    """For a local session only; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="stocktake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder that all executors share.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + _local_folder()
    return f"{base.rstrip('/')}/stocktake-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "part", batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut there.

    ``batch``: rows that a Python worker gets at once, if not the usual number.
    A lost executor costs only its running tasks; the table itself survives.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    settings = STASHING | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files of a stashed table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` (measured) fits the bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def doc_keys(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``(did, rid, text)``: id with nulls replaced, a hash that tells rows of one id apart, text without nulls.

    The hash is odd where there is no id. ``carry`` adds ``row``, a struct of all columns but the text, under which no name can clash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []
    gone = F.col("doc_id").cast("long").isNull().cast("long").alias("gone")
    rid = F.shiftleft(F.xxhash64("did", "text"), 1).bitwiseOR(F.col("gone")).alias("rid")
    return docs.select(did.alias("did"), gone, text.alias("text"), *row).select("did", rid, "text", *["row"] * carry)


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def with_row(schema: str, keyed: DataFrame) -> T.StructType:
    """The schema of a DDL string, with the ``row`` that ``keyed`` carries, if it does."""
    fields = T._parse_datatype_string(schema).fields
    return T.StructType([*fields, *[f for f in keyed.schema.fields if f.name == "row"]])


def new_texts(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, from ``out(text, row)``; ``n_chars`` follows the new text."""
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)


def public_id() -> Column:
    """The id of a row ``(did, rid)``, null again where there was none."""
    return F.when(F.col("rid").bitwiseAND(F.lit(1)) == 0, F.col("did"))
