"""Documents drawn by how much their n-grams look like those of a target collection.

Method. Importance resampling with hashed n-grams: a bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus; a document's weight is the mean gain of its n-grams; a
draw without replacement is the top of weight plus Gumbel noise.

The n-grams of a batch of texts are interned in an open-addressed NumPy table. Its keys are the
xxhash64 of the n-grams' bytes, probing is linear, and each meeting of equal keys is settled by the bytes
themselves, so two n-grams never share a slot. A slot stores the n-gram's bucket (CRC-32 modulo the number of
buckets, computed once a slot) and its count. Corpus statistics add up counts by bucket; weights gather gains
through the slot id of each occurrence.

At scale. Both passes are Arrow maps without a shuffle of text. A task sends at most one row for each
bucket, and the driver gets `buckets` sums. The scores' histogram has a bound: a score is the sum of two
logarithms of doubles in thousandths, so there are some hundred thousand different ones at most. Only rows
from the least drawn score upwards are put in order, by ranges.

Defined results
* null or empty text, or one without words: no features, weight 0; it is drawn by its noise only
  where `least_words` is 0.
* null id: the noise of the empty id, last among ties.
* Repeated rows and ids: each row counts in the corpus and is a document of its own. Rows equal in
  score and id are ranked in any order.
* Empty corpus: empty result. Empty target: all its shares are equal.
* Very long texts: counted in blocks of BLOCK words.
* Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.llm.numbering import numbered
from wareflow.llm.rows import map_texts, pieces, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import LETTERS, U

#: Words of a block: the n-grams that begin there share one table.
BLOCK = 1 << 17
#: Constants of xxhash64.
P1, P2, P3, P4, P5 = map(U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Masks of the low 0 to 8 bytes of a lane.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: N-grams of fewer bytes are hashed and compared as four lanes, longer ones one by one.
SHORT = 32


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def short_hashes(lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 of byte strings of under SHORT bytes. lanes: (n, 4), little-endian, zero behind the string."""
    h = P5 + size.astype(U)
    for j in range(3):
        k = _turn(lanes[:, j] * P2, 31) * P1
        h = np.where(size >= 8 * (j + 1), _turn(h ^ k, 27) * P1 + P4, h)
    tail, rest = lanes[np.arange(len(size)), size >> 3], size & 7
    four = rest >= 4
    h = np.where(four, _turn(h ^ ((tail & MASKS[4]) * P1), 23) * P2 + P3, h)
    tail, rest = np.where(four, tail >> U(32), tail), rest & 3
    for j in range(3):
        h = np.where(rest > j, _turn(h ^ (((tail >> U(8 * j)) & U(0xFF)) * P5), 11) * P1, h)
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


class NgramTable:
    """Byte strings interned by open addressing.

    `slots` has each occurrence's slot; `bucket` and `count` are by slot, 0 where none lives.
    """

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, buckets: int):
        n = len(starts)
        self.data, self.starts, self.sizes = data, starts, sizes
        padded = np.frombuffer(data + bytes(SHORT + 8), np.uint8)
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        self.lanes = np.empty((n, 4), U)
        for j in range(4):
            inside = np.clip(sizes - 8 * j, 0, 8)
            self.lanes[:, j] = eight[np.where(inside > 0, starts + 8 * j, 0)] & MASKS[inside]
        self.keys = short_hashes(self.lanes, np.minimum(sizes, SHORT - 1))
        for k in np.flatnonzero(sizes >= SHORT).tolist():
            self.keys[k] = xxhash.xxh64_intdigest(self._bytes(k))
        self.slots = self._intern(max(16, 1 << (2 * n - 1).bit_length()) if n else 16)
        self.bucket = np.zeros(len(self.owner), np.int64)
        live = np.flatnonzero(self.owner >= 0)
        self.bucket[live] = [zlib.crc32(self._bytes(k)) % buckets for k in self.owner[live].tolist()]
        self.count = np.bincount(self.slots, minlength=len(self.owner))

    def _bytes(self, k: int) -> bytes:
        begin = int(self.starts[k])
        return self.data[begin : begin + int(self.sizes[k])]

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences are the same bytes."""
        same = (self.keys[a] == self.keys[b]) & (self.sizes[a] == self.sizes[b]) & (self.lanes[a] == self.lanes[b]).all(axis=1)
        for k in np.flatnonzero(same & (self.sizes[a] > SHORT)).tolist():
            same[k] = self._bytes(int(a[k])) == self._bytes(int(b[k]))
        return same

    def _intern(self, size: int) -> np.ndarray:
        """Slots of all occurrences; `owner` becomes the occurrence that stands for each slot, or -1."""
        self.owner = np.full(size, -1, np.int64)
        found = np.zeros(len(self.keys), np.int64)
        todo = np.arange(len(self.keys))
        at = (self.keys & U(size - 1)).astype(np.int64)
        while len(todo):
            free = self.owner[at] < 0
            self.owner[at[free]] = todo[free]
            same = self._equal(todo, self.owner[at])
            found[todo[same]] = at[same]
            todo, at = todo[~same], (at[~same] + 1) & (size - 1)
        return found

    def bucket_counts(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        return np.bincount(self.bucket, self.count, buckets).astype(np.int64)


def words_once_spaced(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts with one blank after each, their starts and sizes, and each text's first word."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    inside = LETTERS[data]
    after = np.concatenate(([False], inside[:-1])) & ~inside
    ends = np.flatnonzero(after)
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    borders = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(begins, borders)
    out = np.where(inside, data, 0x20).astype(np.uint8)[inside | after].tobytes()
    sizes = ends - begins
    starts = np.cumsum(sizes + 1) - sizes - 1
    return out, starts, sizes, first


def tables(texts: list[bytes], low: int, high: int, buckets: int) -> Iterator[tuple[NgramTable, np.ndarray]]:
    """A table for each block of words and width, and the number of the text of each occurrence."""
    data, starts, sizes, first = words_once_spaced(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    for begin in range(0, len(starts), BLOCK):
        for width in range(low, high + 1):
            end = min(begin + BLOCK, len(starts) - width + 1)
            if end <= begin:
                continue
            a, b = np.arange(begin, end), np.arange(begin, end) + width - 1
            a, b = (x[doc[a] == doc[b]] for x in (a, b))
            if len(a):
                base, last = int(starts[a[0]]), int(starts[b[-1]] + sizes[b[-1]])
                yield NgramTable(data[base:last], starts[a] - base, starts[b] + sizes[b] - starts[a], buckets), doc[a]


def bucket_counts(df: DataFrame, text: str, low: int, high: int, buckets: int) -> np.ndarray:
    """Occurrences of n-grams in each bucket over all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, text):
                for table, _ in tables(texts_of(part.column(text)), low, high, buckets):
                    total += table.bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # `buckets` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    n, m, k = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [(t + 1) * (n + k) / ((s + 1) * (m + k)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(docs: DataFrame, text: str, gains: np.ndarray, low: int, high: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(part: pa.RecordBatch) -> dict:
        texts = texts_of(part.column(text))
        total, n_features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for table, doc in tables(texts, low, high, len(sent.value)):
            by_slot = sent.value[table.bucket]
            begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[begin]] += np.add.reduceat(by_slot[table.slots], begin)
            n_features += np.bincount(doc, minlength=len(texts))
        n_words = np.diff(words_once_spaced(texts)[3]) if (low, high) != (1, 1) else n_features
        return {"doc_id": part.column("doc_id"), "n_words": n_words, "n_features": n_features, "weight": total // np.maximum(n_features, 1)}

    return map_texts(docs.select("doc_id", text), text, weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256(`<seed>:<id>`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, text: str = "text", target_text: str = "text", widths: tuple[int, int] = (1, 2), buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where it isn't drawn.

    Drawn are `percent` of the rows with `least_words` words, rounded down, by the highest scores. widths:
    the least and the greatest number of words of an n-gram.
    """
    low, high = widths
    gains = gains_of(bucket_counts(docs, text, low, high, buckets), bucket_counts(target, target_text, low, high, buckets))
    scores = weights(docs, text, gains, low, high).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scores = scratch.keep(scores, "scores")
    able = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in scores.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in by_score) // 100
    least, held = None, 0
    for score, n in by_score:
        if held >= wanted:
            break
        least, held = score, held + n
    near = able & (F.col("score") >= least) if least is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    drawn = numbered(scratch.keep(scores.where(near), "near"), scratch, F.lit(0), order)
    rank = F.when(F.col("position") < wanted, F.col("position") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, rank.alias("rank")).unionByName(scores.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
