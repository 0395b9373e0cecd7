"""Lines that many documents share, dropped everywhere.

Method: levelled sorted runs of line hashes. Each batch of documents becomes a sorted run of
(line hash, number of documents). A new batch is merge-anti-joined with the run of lines that are
known to be common, so these never count again, and the rest is added as a run of the first level.
Two runs of a level are merged into one of the next level; lines that reach the threshold there enter the common
run.

Runs are bucketed tables: all have the same number of buckets by the hash, and a bucket is one file in the hash's order. So merging
and anti-joining runs reads equal buckets side by side, without a shuffle and without a sort; only the documents'
own line counts are shuffled, once. The number of batches follows the size of the input, up to
MOST_BATCHES, since each batch is spread over all executors.

Defined results
* null or empty text: one empty line, whose key is empty; it stays, as an empty text.
* A row is a document. A line repeated within one document counts once. Rows repeated as a whole
  count each, and each loses its lines.
* Keys are compared by 128-bit hashes. Ties don't arise: a key is common or it isn't.
* An empty table gives an empty result. Other columns are not read. The caller's columns in `keep`
  travel under names of their own, so names that are used inside do no harm; only where the counts
  are asked for must `keep` not have their names.
* Texts of any length: a document is read whole, in the task that holds its row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.rows import map_texts, text_key, texts_of
from wareflow.llm.store import Scratch, delete, new_path

#: Stripped at both ends of a line to get its key.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Common lines up to this many go to every task as two sorted arrays (16 bytes a line); more of
#: them are joined instead.
MOST_SENT = 1_000_000
#: Bytes of input, as Spark estimates them, for each batch, and the most batches.
BATCH_BYTES, MOST_BATCHES = 64 << 20, 8
#: Lets a scan of a bucket that is one file tell its order.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each line's 16-byte key (null: shorter than `least` code points)."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(BLANKS)
        short = len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least)
        keys.append(None if short else xxhash.xxh3_128_digest(key))
    return lines, keys


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)


def line_counts(docs: DataFrame, text: str, batches: int, least: int, buckets: int) -> DataFrame:
    """(batch, h1, h2, n): documents of a batch that hold the line, dealt to buckets by the line."""

    def keys(part: pa.RecordBatch) -> dict:
        found: list[bytes] = []
        for t in texts_of(part.column(text)):
            found += {k for k in line_keys(t, least)[1] if k is not None}
        pairs, n = np.unique(_halves(found), axis=0, return_counts=True) if found else (np.empty((0, 2), np.int64), [])
        return {"h1": pairs[:, 0], "h2": pairs[:, 1], "n": np.asarray(n, np.int64)}

    found = map_texts(docs.select(text), text, keys, "h1 long, h2 long, n long")
    found = found.select(F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"), "h1", "h2", "n")
    return found.repartition(buckets, "h1", "h2").groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))


@contextmanager
def _ordered_scans(spark: SparkSession) -> Iterator[None]:
    """While it lasts, plans take a bucket of one file to be in its stored order."""
    old = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, old)


class LineRuns:
    """Sorted runs of line hashes in levels, and the run of common lines. Runs are h1, h2 and n."""

    def __init__(self, spark: SparkSession, threshold: int, buckets: int):
        self.spark, self.threshold, self.buckets = spark, threshold, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.common: DataFrame | None = None
        self.tables: list[tuple[DataFrame, str, str]] = []

    def store(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write rows that lie in their buckets' tasks, as one sorted file for each bucket."""
        path, name = new_path(self.spark, "run"), f"wareflow_run_{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.tables.append((out, name, path))
        return out

    def drop(self, *runs: DataFrame) -> None:
        """Drop tables that `store` returned; others, such as a batch of one, are left alone."""
        for own, name, path in [t for t in self.tables if any(t[0] is r for r in runs)]:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, path)
            self.tables = [t for t in self.tables if t[1] != name]

    def fresh(self, counts: DataFrame) -> DataFrame:
        """What of a batch isn't known to be common."""
        return counts if self.common is None else counts.join(self.common.hint("merge"), ["h1", "h2"], "left_anti")

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, with the counts added up."""
        both = a.hint("merge").join(b.withColumnRenamed("n", "m"), ["h1", "h2"], "full")
        return both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch: h1, h2 and the number n of its documents with that line, a stored run or a part of one."""
        with _ordered_scans(self.spark):
            new = self.fresh(counts)
            self.levels[0].append(new if new is counts else self.store(new))
            level = 0
            while len(self.levels[level]) == 2:
                pair, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._compact(*pair))
                level += 1

    def _compact(self, a: DataFrame, b: DataFrame) -> DataFrame:
        run = self.store(self.merged(a, b))
        self._settle(run)
        self.drop(a, b)
        return run

    def _settle(self, run: DataFrame) -> None:
        found, old = run.where(f"n >= {self.threshold}"), self.common
        self.common = self.store(found if old is None else self.merged(old, found))
        if old is not None:
            self.drop(old)

    def common_lines(self) -> DataFrame:
        """(h1, h2) of the lines that `threshold` documents hold, over all levels."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            raise ValueError("no batch was added")
        with _ordered_scans(self.spark):
            last = runs[0]
            for run in runs[1:]:
                last = self._compact(last, run)
            if len(runs) == 1:
                self._settle(last)
            self.drop(last)
        self.levels = [[]]
        assert self.common is not None
        return self.common.select("h1", "h2")


def _in_sorted(h1: np.ndarray, h2: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the pairs (h1, h2), sorted by h1 and then h2."""
    hit = np.zeros(len(keys), bool)
    at = np.searchsorted(h1, keys[:, 0])
    while True:
        same = at < len(h1)
        same[same] = h1[at[same]] == keys[same, 0]
        if not same.any():
            return hit
        hit[same] |= h2[at[same]] == keys[same, 1]
        at = np.where(same, at + 1, len(h1))


def _cut(part: pa.RecordBatch, text: str, least: int, drop: Iterator[set[int]] | None, h: tuple | None) -> dict:
    """Kept texts and counts of a batch; drop: each text's common keys, where they were joined."""
    n_lines, n_dropped, kept = [], [], []
    rows = [line_keys(t, least) for t in texts_of(part.column(text))]
    flat = [k for _, keys in rows for k in keys if k is not None]
    if h is not None:
        common = iter(_in_sorted(h[0], h[1], _halves(flat)) if flat else [])
    for lines, keys in rows:
        if h is not None:
            out = [k is not None and bool(next(common)) for k in keys]
        else:
            bad = next(drop)
            out = [k is not None and k in bad for k in keys]
        n_lines.append(len(lines))
        n_dropped.append(sum(out))
        kept.append(b"\n".join(x for x, o in zip(lines, out) if not o))
    return {"n_lines": n_lines, "n_dropped": n_dropped, "kept": kept}


def drop_common_lines(docs: DataFrame, common: DataFrame, text: str = "text", least: int = 1, most_sent: int = MOST_SENT, keep: tuple[str, ...] = ("doc_id",), digest: bool = False, counts: bool = True) -> DataFrame:
    """`keep` columns, n_lines and n_dropped (if `counts`) and the remaining text (or its SHA-256) of each row.

    Up to `most_sent` common lines, counted first, are sent to every task. Beyond that, each
    document's line keys meet the common lines in a join, which adaptive execution splits where a
    line is in very many documents.
    """
    spark = docs.sparkSession
    few = common.limit(most_sent + 1).count() <= most_sent
    left = "kept_sha256" if digest else text
    results = {"n_lines": "n_lines", "n_dropped": "n_dropped", "left": left} if counts else {"left": left}
    twice = set(keep) & set(results.values())
    if twice:
        raise ValueError(f"columns to keep have names of results: {sorted(twice)}")
    own = {f"own_{k}": c for k, c in enumerate(keep)}
    kinds = [f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in own.items()]
    schema = ", ".join([*kinds, "n_lines long", "n_dropped long", "left string"])
    docs = docs.select(*(F.col(f"`{c}`").alias(name) for name, c in own.items()), F.col(f"`{text}`").alias("text"))

    def finish(part: pa.RecordBatch, found: dict) -> dict:
        kept = found["kept"]
        rest = [hashlib.sha256(x).hexdigest() for x in kept] if digest else pa.array(kept, pa.binary()).cast(pa.string())
        return {name: part.column(name) for name in own} | {"n_lines": found["n_lines"], "n_dropped": found["n_dropped"], "left": rest}

    def named_back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(a).alias(b) for a, b in (own | results).items()))

    if few:
        rows = common.select("h1", "h2").toPandas().to_numpy(np.int64).reshape(-1, 2)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        sent = spark.sparkContext.broadcast((rows[:, 0].copy(), rows[:, 1].copy()))
        return named_back(map_texts(docs, "text", lambda p: finish(p, _cut(p, "text", least, None, sent.value)), schema))

    def row_keys(part: pa.RecordBatch) -> dict:
        found, key = [], []
        for k, t in zip(part.column("k_").to_pylist(), texts_of(part.column("text"))):
            lines = {x for x in line_keys(t, least)[1] if x is not None}
            found += lines
            key += [k] * len(lines)
        pairs = _halves(found) if found else np.empty((0, 2), np.int64)
        return {"k_": key, "h1": pairs[:, 0], "h2": pairs[:, 1]}

    named = docs.withColumn("k_", text_key(F.col("text")))
    hits = map_texts(named.select("k_", "text"), "text", row_keys, "k_ long, h1 long, h2 long").join(common, ["h1", "h2"])
    hits = hits.groupBy("k_").agg(F.collect_set(F.struct("h1", "h2")).alias("hits_"))

    def cut(part: pa.RecordBatch) -> dict:
        drop = (set(_halves_to_keys(x)) for x in part.column("hits_").to_pylist())
        return finish(part, _cut(part, "text", least, drop, None))

    return named_back(map_texts(named.join(hits, "k_", "left"), "text", cut, schema))


def _halves_to_keys(pairs: list[dict] | None) -> list[bytes]:
    return [x["h1"].to_bytes(8, "big", signed=True) + x["h2"].to_bytes(8, "big", signed=True) for x in pairs or []]


def dedup_lines(docs: DataFrame, scratch: Scratch, text: str = "text", threshold: int = 10, least: int = 1, batches: int | None = None, **how) -> DataFrame:
    """Drop every line whose key is in `threshold` documents or more.

    The documents' line counts are written once, split in `batches` (by default one for
    each BATCH_BYTES of input); batch after batch then goes through LineRuns. `how` is passed to drop_common_lines.
    """
    spark = docs.sparkSession
    if batches is None:
        size = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        batches = min(MOST_BATCHES, max(1, size // BATCH_BYTES))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, threshold, buckets)
    counts = runs.store(line_counts(docs, text, batches, least, buckets), partition_by="batch")
    for batch in range(batches):
        runs.add(counts.where(F.col("batch") == batch).select("h1", "h2", "n"))
    found = scratch.keep(runs.common_lines(), "common")
    runs.drop(*[t[0] for t in runs.tables])
    return drop_common_lines(docs, found, text, least, **how)
