"""Line dedup: two Bloom filters find suspected repeats; only those are shuffled for exact confirmation.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents keep their lines only in the largest id that holds them; elsewhere all
lines of that key go. Suspected lines are confirmed on their whole keys.

Defined results: null and empty texts are one empty line; documents are told
apart by their ids, so rows that repeat an id count once, whatever their texts, and
all of them keep the lines whose largest id is theirs; rows without an id count as
one document with the smallest id; texts and lines of any length are read whole;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import doc_keys, drop_stash, public_id, stash, table, text_bytes, with_row
from stocktake.llm.repeats import suspects


def line_keys(text: str) -> list[bytes]:
    """The key of every line (bytes' strip and lower are ASCII only, as the key's definition)."""
    return [x.strip() for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or sum(1 for c in key if c & 0xC0 != 0x80) >= chars)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: bool = False) -> DataFrame:
    """``(did, rid, doc_id, text, n_lines, n_dropped)``, and ``row`` with ``carry``: what is left of every row's text."""
    keyed = doc_keys(docs)
    lines = text_bytes(keyed) // 64  # about; it only decides how many ranges there are

    def keys_of(text: str) -> list[bytes]:
        return list({k for k in line_keys(text) if _long(k, min_chars)})

    def hashes(text: str) -> np.ndarray:
        return np.unique(np.array([xxhash.xxh3_64_intdigest(k) for k in keys_of(text)], np.uint64))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (t, suspected) in enumerate(zip(b["text"].to_pylist(), b["hashes"].to_pylist())):
                suspected = set(suspected)
                own = [k for k in keys_of(t) if np.uint64(xxhash.xxh3_64_intdigest(k)).view(np.int64) in suspected]
                keys += own
                at += [i] * len(own)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["did"].take(at), b["rid"].take(at), pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()), pa.array(keys, pa.binary())], ["did", "rid", "dig", "key"])

    maybe = stash(suspects(keyed, hashes, lines).groupBy("did", "rid").agg(F.collect_set("hash").alias("hashes")), "suspects")
    found = keyed.join(maybe.hint("merge"), ["did", "rid"]).select("did", "rid", "text", "hashes")
    held = stash(found.mapInArrow(fetch, "did long, rid long, dig binary, key binary"), "keys")
    drop_stash(maybe)
    # exact: on whole keys, once a document, summed within tasks first
    once = held.select("dig", "key", "did").distinct()
    sure = stash(once.groupBy("dig", "key").agg(F.count("*").alias("n"), F.max("did").alias("keep")).where(F.col("n") >= min_docs).select("dig", "key", "keep"), "confirmed")
    gone = held.join(sure, ["dig", "key"]).where("did != keep").select("did", "rid", "dig")
    drops = stash(gone.groupBy("did", "rid").agg(F.collect_set("dig").alias("digs")), "drops")
    drop_stash(held)
    drop_stash(sure)
    # drops grow with the documents: texts are dealt by document at every size
    joined = doc_keys(docs, carry).join(drops.hint("merge"), ["did", "rid"], "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, dropped = [], [], []
            for t, digs in zip(b["text"].to_pylist(), b["digs"].to_pylist()):
                n = t.count("\n") + 1
                if digs:
                    digs = set(digs)
                    left = [x for x, k in zip(t.split("\n"), line_keys(t)) if not (_long(k, min_chars) and xxhash.xxh3_128_digest(k) in digs)]
                    t = "\n".join(left)
                    dropped.append(n - len(left))
                else:
                    dropped.append(0)
                total.append(n)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b["did"], b["rid"], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), *([b["row"]] if carry else [])], ["did", "rid", "text", "n_lines", "n_dropped", *["row"] * carry])

    schema = with_row("did long, rid long, text string, n_lines long, n_dropped long", joined)
    out = joined.select("did", "rid", "text", "digs", *["row"] * carry).mapInArrow(keep, schema)
    return out.select("did", "rid", public_id().alias("doc_id"), "text", "n_lines", "n_dropped", *["row"] * carry)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, (r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keep) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
