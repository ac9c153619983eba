"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer, exactly.

The words of the corpus (pieces of the tokenizer's own pattern) are counted over all documents. The most frequent ones are merged once and
compiled into a minimal acyclic transducer, which every Python worker memory-maps; all other words are merged where they
occur, so that the result never depends on which words were compiled.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.llm.sizes import Pairs, Sizes, kinds
from loomgraph.llm.transducer import Transducer

#: Where the public vocabulary is, as a file of base64 tokens and ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that belongs to this public vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words compiled into the transducer: the most frequent of the corpus. Bounds what goes to the driver, not what is encoded.
LEXICON_WORDS = 40_000
#: Distinct words counted in a task before the counts so far are handed on.
COUNT_FLUSH = 200_000
#: Merged words that a task remembers beside the transducer, and code points of one piece of work within a batch.
REMEMBERED, WORK = 50_000, 1 << 20


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the neighbours with the lowest rank are merged, the leftmost first, until none can be."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    # parts as a linked list of starts; each candidate pair is in the heap with the ends it had when it was pushed
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if not gone[i] else n
        if gone[i] or j >= n or end[j] != stop:
            continue
        end[i], gone[j], nxt[i] = stop, 1, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            k = nxt[j]
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over the whole corpus. Counted within tasks first, so that what is shuffled are distinct words."""
    split = regex.compile(PATTERN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(split.findall(t))
                    if len(seen) > COUNT_FLUSH:
                        yield out()
        yield out()

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, ranks: dict[bytes, int], most: int = LEXICON_WORDS) -> Transducer:
    """The transducer of the `most` most frequent words that occur at least twice (ties by the word)."""
    top = word_counts(docs, text).where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word")
    return Transducer.compile({w: merge(w, ranks) for w in (r["word"].encode() for r in top.collect())})


class Encoder:
    """Encodes batches of texts with a transducer and, for the words it lacks, by merging."""

    def __init__(self, lexicon: Transducer, ranks: dict[bytes, int]):
        self.lexicon, self.ranks, self.split, self.known = lexicon, ranks, regex.compile(PATTERN), {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids by text, all ids). Null and empty texts have none."""
        sizes, ids = [], []
        for part in _pieces(texts):
            n, first, size, code, pool = self._part(part)
            total = np.cumsum(size[code])
            sizes.append(n)
            ids.append(pool[np.repeat(first[code] - total + size[code], size[code]) + np.arange(total[-1])] if len(code) else pool[:0])
        return np.concatenate(sizes), np.concatenate(ids)

    def _part(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids by text, by distinct word the place and number of its ids in the pool, the words' numbers in order, pool)."""
        flat: list[str] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                flat += self.split.findall(t)
            upto[i + 1] = len(flat)
        if not flat:
            none = np.zeros(0, np.int64)
            return np.zeros(len(texts), np.int64), none, none, none, np.zeros(0, np.int32)
        code, words = pd.factorize(np.array(flat, object))
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(length) - length
        number = self.lexicon.look_up(np.frombuffer(b"".join(raw), np.uint8), start, length)
        # id lists of the distinct words, one after another: spans of the transducer's outputs, then the merged ones
        first, size = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        have = number >= 0
        first[have] = self.lexicon.out_start[number[have]]
        size[have] = self.lexicon.out_start[number[have] + 1] - first[have]
        merged: list[int] = []
        base = len(self.lexicon.out_ids)
        for i in np.flatnonzero(~have):
            w = raw[i]
            ids = self.known.get(w)
            if ids is None:
                ids = merge(w, self.ranks)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                if len(w) < 100:
                    self.known[w] = ids
            first[i], size[i] = base + len(merged), len(ids)
            merged += ids
        pool = np.concatenate([self.lexicon.out_ids, np.array(merged, np.int32)])
        return np.diff(np.r_[0, np.cumsum(size[code])][upto]), first, size, code, pool


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about WORK code points; at least one, which may be empty."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= WORK:
            yield part
            part, size = [], 0
    yield part


def ship(spark: SparkSession, lexicon: Transducer) -> str:
    """Writes the transducer to the shared folder and has Spark hand it to every executor; its file name there."""
    path = storage.write_bytes(spark, f"lexicon-{uuid.uuid4().hex[:8]}", lexicon.to_bytes())
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def _per_batch(docs: DataFrame, id_column: str, text: str, ranks: dict[bytes, int], lexicon: Transducer, make, kind: str) -> DataFrame:
    spark = docs.sparkSession
    name = ship(spark, lexicon)
    shared = spark.sparkContext.broadcast(ranks)  # the public vocabulary: 50,000 entries, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Transducer.memory_map(SparkFiles.get(name)), shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), make(enc, b.column(1).to_pylist())], ["id", "out"])

    id_kind = dict(docs.dtypes)[id_column]
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {id_kind}, out {kind}")
    return out.withColumnRenamed("id", id_column)


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every row, in the tokenizer's ids without special tokens; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text. Repeated rows and null ids are kept as they are, further columns
    are ignored, an empty table gives no rows. Texts are never cut; a worker takes them up in pieces of WORK code points.
    """

    def lists(enc: Encoder, texts: list[str | None]) -> pa.Array:
        n, ids = enc.encode(texts)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids, pa.int32()))

    ranks = load_ranks(vocabulary)
    return _per_batch(docs, id_column, text, ranks, build_lexicon(docs, text, ranks), lists, "array<int>").withColumnRenamed("out", "ids")


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens long) of every row: the size of encode's list.

    No pass over the corpus comes first: the vocabulary's own words and the words met before are looked up, all others are merged where they occur.
    """
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, Pairs.of(ranks), kinds()))  # made of the public vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sizes(*shared.value, merge)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.count(b.column(1)), pa.int64())], ["id", "n_tokens"])

    id_kind = dict(docs.dtypes)[id_column]
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {id_kind}, n_tokens long")
    return out.withColumnRenamed("id", id_column)
