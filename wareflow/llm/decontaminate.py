"""Documents that hold passages of a benchmark, by a distributed positional inverted index.

Method. The index is partitioned by document: each shard of a few thousand documents holds, for every
term, the sorted list of its positions in the shard. It is written once to the shared folder. A
search takes the benchmark's windows to every shard. There it starts each window from the list of its
rarest term, subtracts the term's offset, and intersects with the offset-adjusted lists of the other
terms from rare to frequent: what is left are exact occurrences. Proximity matches are found from the
same lists: all terms of the window, in any order, within `reach` words of an occurrence of its
anchor, which is its rarest term in the whole corpus and the first of several.

An index for given terms leaves all other words out. The benchmark goes to the shards in blocks of at
most MOST_WINDOWS windows; if it has more than MOST_TERMS terms, all words are indexed instead.

Defined results
* null or empty text: no words, no hits, not contaminated. An item without words has no window.
* An item of fewer words than a window is one window. Equal windows of several items count for each.
* null item_id: its windows count as hits but name no item; rows with one item_id are one item.
* null doc_id and repeated rows: each row is reported. An empty benchmark hits nothing; an empty
  table gives an empty result. Other columns are not read.
* Words are compared by 64-bit hashes. A document of any length is indexed whole, in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wareflow.llm.rows import pieces, text_key, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import LETTERS, U, chunks, hashed_windows, hashed_words

#: Terms and windows that are sent to every task at once.
MOST_TERMS, MOST_WINDOWS = 2_000_000, 500_000
#: Documents and bytes of a shard, and candidates that are intersected at once.
SHARD_DOCS, SHARD_BYTES, CANDIDATES = 4_096, 6 << 20, 400_000
#: Words between two documents in a shard's positions.
GAP = 1 << 10
SHIFT = U(40)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def shard_of(texts: list[bytes], terms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's terms, length of each list, positions list after list, and words of each text.

    terms: sorted hashes of the terms to index, or null for all words.
    """
    held, where, n_words, at = [], [], [], 0
    for begin, end in chunks(texts):
        hashes, first = hashed_words(texts[begin:end], LETTERS)
        own = np.diff(first)
        starts = at + np.cumsum(own + GAP) - own - GAP
        places = np.repeat(starts - first[:-1], own) + np.arange(first[0], first[-1])
        at = int(starts[-1] + own[-1] + GAP)
        n_words.append(own)
        if terms is not None:
            k = np.searchsorted(terms, hashes)
            k[k == len(terms)] = 0
            known = terms[k] == hashes if len(terms) else np.zeros(len(hashes), bool)
            hashes, places = hashes[known], places[known]
        held.append(hashes)
        where.append(places)
    hashes, places = np.concatenate(held), np.concatenate(where)
    order = np.argsort(hashes, kind="stable")
    own, lengths = np.unique(hashes, return_counts=True)
    return own, lengths, places[order], np.concatenate(n_words)


def build_index(docs: DataFrame, text: str, terms: np.ndarray | None) -> DataFrame:
    """One row for each shard: its documents, their words, and the position list of each term."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType)
    element = schema["doc_id"].dataType.simpleString()
    out = StructType.fromDDL(f"doc_ids array<{element}>, rows array<long>, n_words array<long>, terms binary, lengths binary, steps binary")
    arrow = to_arrow_schema(out)

    def shard(ids: list, rows: list, texts: list[bytes]) -> pa.RecordBatch:
        own, lengths, places, n_words = shard_of(texts, sent.value)
        values = (ids, rows, n_words, _packed(own), _packed(lengths.astype(np.int64)), _packed(np.diff(places, prepend=0).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, arrow)], schema=arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, texts, size = [], [], [], 0
        for batch in batches:
            for part in pieces(batch, text):
                ids += part.column("doc_id").to_pylist()
                rows += part.column("row_").to_pylist()
                texts += (new := texts_of(part.column(text)))
                size += sum(map(len, new))
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(ids, rows, texts)
                    ids, rows, texts, size = [], [], [], 0
        if ids:
            yield shard(ids, rows, texts)

    return docs.select("doc_id", text, text_key(F.col(text)).alias("row_")).mapInArrow(build, out)


def benchmark_windows(benchmark: DataFrame, text: str, width: int) -> DataFrame:
    """(window, words, items): each distinct window, its word hashes and the items that have it."""
    out = StructType.fromDDL("item string, window long, words array<long>")
    arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, keys, words = [], [], []
            for item, t in zip(batch.column("item").to_pylist(), texts_of(batch.column(text))):
                hashes, _ = hashed_words([t], LETTERS)
                size = min(width, len(hashes))
                if size:
                    found = hashed_windows(hashes, size) + U(size)
                    items += [item] * len(found)
                    keys += found.view(np.int64).tolist()
                    words += list(np.lib.stride_tricks.sliding_window_view(hashes.view(np.int64), size))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((items, keys, words), arrow)], schema=arrow)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text).mapInArrow(cut, out)
    return rows.groupBy("window").agg(F.any_value("words").alias("words"), F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): positions of each term in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("terms").to_pylist(), batch.column("lengths").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(a, "i8")), pa.array(_unpacked(b, "i8"))], names=["term", "n"])

    counts = index.select("terms", "lengths").mapInArrow(count, "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


class Windows:
    """A block of windows as flat arrays: distinct terms, (window, offset) -> term, and anchors."""

    def __init__(self, rows: list):
        self.items = [r.items for r in rows]
        self.size = np.array([len(r.words) for r in rows], np.int64)
        flat = np.array([w for r in rows for w in r.words], np.int64).view(U)
        self.terms, which = np.unique(flat, return_inverse=True)
        width = int(self.size.max()) if len(rows) else 0
        #: Term number at each offset; -1 after the end of a short window.
        self.grid = np.full((len(rows), width), -1, np.int64)
        self.grid[np.arange(width) < self.size[:, None]] = which
        self.anchor = np.zeros(len(rows), np.int64)

    def set_anchors(self, counts: dict[int, int]) -> None:
        """Each window's anchor: the offset of its rarest term in the corpus, the first of several."""
        n = np.array([counts.get(t, 0) for t in self.terms.view(np.int64).tolist()] + [np.iinfo(np.int64).max])
        if len(self.grid):
            self.anchor = n[self.grid].argmin(axis=1)


class Lists:
    """The position lists of a shard, as one sorted array of (term number, position)."""

    def __init__(self, windows: Windows, terms: np.ndarray, lengths: np.ndarray, places: np.ndarray):
        at = np.searchsorted(terms, windows.terms)
        at[at == len(terms)] = 0
        #: Number of each of the windows' terms in the shard, and the length of its list.
        self.at, self.count = at, np.where(terms[at] == windows.terms, lengths[at], 0)
        self.first, self.places = np.cumsum(lengths) - lengths, places
        self.keys = (np.repeat(np.arange(len(terms)), lengths).astype(U) << SHIFT) | places.astype(U)

    def next(self, term: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of (term, place) and the least key in the lists from there on."""
        wanted = (self.at[term].astype(U) << SHIFT) | np.maximum(place, 0).astype(U)
        found = np.searchsorted(self.keys, wanted)
        found[found == len(self.keys)] = 0
        return wanted, self.keys[found]

    def starts(self, windows: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into windows, position) of one term's list for each window, in bounded parts."""
        sizes = self.count[terms]
        total = np.cumsum(sizes)
        begin = 0
        while begin < len(windows):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + CANDIDATES, side="right")))
            n = sizes[begin:end]
            list_at = self.first[self.at[terms[begin:end]]]
            yield np.repeat(np.arange(begin, end), n), self.places[np.repeat(list_at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin = end


def occurrences(windows: Windows, terms: np.ndarray, lengths: np.ndarray, places: np.ndarray, reach: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("exact", window, first position) and ("near", window, position of its anchor)."""
    if not len(windows.grid) or not len(terms):
        return
    lists, grid = Lists(windows, terms, lengths, places), windows.grid
    counts = np.where(grid >= 0, lists.count[grid], np.iinfo(np.int64).max)
    alive = np.flatnonzero(counts.min(axis=1) > 0)
    order = np.argsort(counts[alive], axis=1, kind="stable")
    for row, place in lists.starts(alive, grid[alive, order[:, 0]]):
        start = place - order[row, 0]
        for k in range(1, grid.shape[1]):
            column = order[row, k]
            term = grid[alive[row], column]
            wanted, found = lists.next(term, start + column)
            good = (term < 0) | ((wanted == found) & (start + column >= 0))
            row, start = row[good], start[good]
        yield "exact", alive[row], start
    if reach:
        for row, place in lists.starts(alive, grid[alive, windows.anchor[alive]]):
            for k in range(grid.shape[1]):
                term = grid[alive[row], order[row, k]]
                wanted, found = lists.next(term, place - reach)
                good = (term < 0) | ((found >= wanted) & (found <= (lists.at[term].astype(U) << SHIFT | (place + reach).astype(U))))
                row, place = row[good], place[good]
            yield "near", alive[row], place


def shard_hits(windows: Windows, n_words: np.ndarray, terms: np.ndarray, lengths: np.ndarray, steps: np.ndarray, reach: int) -> Iterator[tuple[int, list, list, list, list]]:
    """(text number, begins, ends of hit words, items, near items) of each text with a match."""
    places = np.cumsum(steps)
    begins = np.cumsum(n_words + GAP) - n_words - GAP
    exact, near = [], []
    for kind, window, place in occurrences(windows, terms, lengths, places, reach):
        (exact if kind == "exact" else near).append((window, place, np.searchsorted(begins, place, side="right") - 1))
    by_doc: dict[int, tuple[list, list, set, set]] = {}
    for found, slot in ((exact, 2), (near, 3)):
        for window, place, doc in found:
            order = np.lexsort((place, doc))
            window, place, doc = window[order], place[order], doc[order]
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                own = by_doc.setdefault(int(doc[a]), ([], [], set(), set()))
                for w in set(window[a:b].tolist()):
                    own[slot].update(windows.items[w])
                if slot == 2:
                    own[0].extend((place[a:b] - begins[doc[a]]).tolist())
                    own[1].extend((place[a:b] - begins[doc[a]] + windows.size[window[a:b]]).tolist())
    for doc, (starts, ends, items, close) in sorted(by_doc.items()):
        merged = merged_ranges(starts, ends)
        yield doc, [a for a, _ in merged], [b for _, b in merged], sorted(items), sorted(close)


def merged_ranges(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Disjoint ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begins, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, block: Windows, reach: int) -> DataFrame:
    """(doc_id, row_, begins, ends, items, near) of each document with a match in this block."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    element = index.schema["doc_ids"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"doc_id {element}, row_ long, begins array<long>, ends array<long>, items array<string>, near array<string>")
    arrow = to_arrow_schema(out)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("doc_ids", "rows", "n_words")}
                lists = [_unpacked(batch.column(c)[k].as_py(), kind) for c, kind in (("terms", "u8"), ("lengths", "i8"), ("steps", "i8"))]
                hits = list(shard_hits(sent.value, np.array(one["n_words"], np.int64), *lists, reach))
                columns = zip(*((one["doc_ids"][d], one["rows"][d], *rest) for d, *rest in hits)) if hits else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return index.mapInArrow(find, out)


def _words_hit(begins: Column, ends: Column) -> Column:
    """Words in the union of ranges; ranges of one block are disjoint, those of several may not be."""
    ranges = F.array_sort(F.arrays_zip(begins.alias("a"), ends.alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, r: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], state["end"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["end"], r["b"]).alias("end"))

    return F.aggregate(ranges, start, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", width: int = 13, share: int = 20, reach: int = 26) -> DataFrame:
    """doc_id, row_, n_words, n_hit, items, near_items and contaminated of every row.

    contaminated: n_hit > 0 and share * n_hit >= n_words. row_ is the text's key.
    """
    windows = scratch.keep(benchmark_windows(benchmark, text, width), "windows")
    words = windows.select(F.explode("words").alias("w")).distinct()
    found = [r.w for r in words.limit(MOST_TERMS + 1).collect()]
    terms = np.unique(np.array(found, np.int64).view(U)) if len(found) <= MOST_TERMS else None
    index = scratch.keep(build_index(docs, text, terms), "index")
    blocks = max(1, -(-windows.count() // MOST_WINDOWS))
    counts = scratch.keep(term_counts(index), "counts")
    hits: DataFrame | None = None
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        block = Windows(rows.collect())
        own = rows.select(F.explode("words").alias("term")).distinct()
        block.set_anchors({r.term: r.n for r in counts.join(own, "term").collect()})
        own = search(index, block, reach)
        hits = own if hits is None else hits.union(own)
    # Repeated rows and several blocks meet here; each holds no more than one document's matches.
    spans = F.arrays_zip("begins", "ends")
    hits = hits.select("doc_id", "row_", spans.alias("spans"), "items", "near").groupBy("doc_id", "row_").agg(
        *(F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "items", "near"))
    )
    hits = scratch.keep(
        hits.select(
            F.col("doc_id").alias("id_"),
            F.col("row_").alias("key_"),
            _words_hit(F.col("spans.begins"), F.col("spans.ends")).alias("n_hit"),
            F.array_sort(F.array_distinct("items")).alias("items"),
            F.array_sort(F.array_distinct("near")).alias("near_items"),
        ),
        "hits",
    )
    rows = index.select(F.explode(F.arrays_zip("doc_ids", "rows", "n_words")).alias("d"))
    rows = rows.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.rows").alias("row_"), F.col("d.n_words").alias("n_words"))
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["id_"]) & (rows["row_"] == hits["key_"]), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "row_",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result with its items as a count and a SHA-256 of their ids."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )
