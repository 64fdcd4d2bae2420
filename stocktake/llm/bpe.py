"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary file is a parameter (JSON of the tokenizers library with a BPE
model, a Split pattern and byte-level symbols). Encoding takes the best-ranked
pair from the queue, skips it when one of its symbols has changed since, merges
it in the linked list and queues the two new neighbour pairs. Decoding looks the
ids' strings up and concatenates them, with the joiner that the file's missing
decoder implies (one space).

Defined results: null texts are empty and give no ids; the digests of an empty
text are those of the empty string; strings of special tokens in a text become
their ids, as that library has it; rows that repeat an id each give a row; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import table

#: Distinct chunks, and words, whose encodings a Python worker keeps in each of two generations.
CACHE_CHUNKS = 150_000
#: Unicode white space, as the vocabulary's patterns mean it.
_WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ODD = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(f"[{_WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable Latin-1, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Recent(dict):
    """A bounded memo: when it is full, it becomes the old generation, and what is asked for again moves on."""

    def __init__(self, make: Callable[[str], tuple]):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple:
        found = self.old.get(key) or self.make(key)
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        # pairs and ranks as single numbers: ids of both sides, and the rank
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a] << 20 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        (pattern,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [self.ids.get(c, -1) for c in symbols]
        self.last = [self.ids.get(c + self.end, -1) for c in symbols]
        self.words = Recent(self._word)
        self.cache = Recent(self._chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one word of the pattern. A queue entry is a rank and the place of the pair's left symbol."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) == 1:
            return ids
        n, rank_of, made = len(ids), self.merges.get, self.made
        queue = []
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            rank = pop(queue)
            i = rank & 0xFFFFFFFF
            rank >>= 32
            j = after[i]
            if j < 0 or ids[i] < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of its symbols has been merged since
            ids[i] = new = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank = rank_of(new << 20 | ids[k])
                if rank is not None:
                    push(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 20 | new)
                if rank is not None:
                    push(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.merge(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Decimal ids of a chunk without white space, and their strings, each joined by spaces."""
        found = [self.words[w] for w in ([chunk] if chunk.isalpha() else self.pattern.findall(chunk))]
        return " ".join([i for i, _ in found]).encode(), " ".join([t for _, t in found]).encode()

    def chunks(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield str(self.special[part]).encode(), part.encode()
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            get = self.cache
            for c in _SPLIT.split(part) if _ODD.search(part) else part.split():
                if c:
                    yield get[c]

    def both(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by spaces, and the decoded text."""
        found = [c for c in self.chunks(text) if c[0]]
        if not found:
            return b"", b""
        ids, strings = zip(*found)
        ids, strings = b" ".join(ids), b" ".join(strings)
        return ids, strings

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.both(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``; a worker reads it once."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([bpe.encode(t or "") for t in b["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b["text"].to_pylist():
                ids, text = bpe.both(t or "")
                n.append(ids.count(b" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
