"""Tokenised documents packed into fixed windows with little padding.

Method: best-fit decreasing. Overlong documents are first cut into full windows and a rest. The
pieces, longest first, each go to the open window with the least capacity that still holds them; a
segment tree indexed by remaining capacity finds it, or tells that a new window has to be opened.

Pieces are dealt evenly, by a hash of their row, to groups of about `group` pieces, or of more where these
would fill under WINDOWS windows, and each group is packed by itself; a group wastes a window or two at
its end, so padding stays small at every size and for documents of any length, while no task sees more
than its group. Only lengths travel, not ids, unless ids are asked for.

Defined results
* null or empty text: a document of the end id alone.
* null ids, repeated rows and repeated ids are separate documents; each is packed.
* Ties in length go to the earlier row. An empty table gives an empty result.
* Other columns are not read.
* A document of any length is tokenised whole in its row's task.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from wareflow.llm.rows import map_texts, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import NOT_BLANK, chunks, word_spans

#: Words that a worker remembers with their ids (about 40 bytes each), and parts of words.
MOST_WORDS, MOST_PARTS, LONGEST_PART = 600_000, 150_000, 48
#: Windows that a group fills at least, and pieces that it holds at most for that.
WINDOWS, MOST_PIECES = 200, 262_144
#: Stands between words; no id has these bytes.
LINE = b"\xff\xff\xff\xff"

# The normaliser and pre-tokenizer that WordEncoder's shortcuts are made for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_encoders: dict[str, "WordEncoder"] = {}


def _latin(kinds: str) -> str:
    """A character class of the printable Latin-1 characters of some Unicode categories."""
    return "".join(re.escape(c) for c in map(chr, range(0x21, 0x100)) if unicodedata.category(c)[0] in kinds)


class WordEncoder:
    """Ids of whole texts, by a lower-casing word-end BPE tokenizer of the `tokenizers` library.

    Its pre-tokenizer never joins what a blank parts, so a text's ids are those of its blank-separated
    words one after another. Words are encoded once and kept by a 64-bit hash of their lower case:
    sorted hashes, and for each where its ids lie in one array. A word of printable Latin-1
    characters needs no normaliser beyond lower-casing: it is cut by the tokenizer's own pattern, and
    its parts go to the tokenizer's model together with many others. All other words, and texts with
    what may be a special token, go through the whole tokenizer.

    The file tells whether its tokenizer is such a one; with any other, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = (self.tokenizer.normalizer, NORMALIZER), (self.tokenizer.pre_tokenizer, PRE_TOKENIZER)
        same = all(part is not None and json.loads(part.__getstate__()) == wanted for part, wanted in parts)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.by_words = same and isinstance(self.tokenizer.model, models.BPE) and all("<|" in token.content for token in tokens)
        self.model = Tokenizer(self.tokenizer.model)
        split, levels = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([split, levels])
        letters, numbers = _latin("L"), _latin("N")
        self.plain = re.compile(r"[!-~\u00a1-\u00ff]+").fullmatch
        self.parts_of = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}\n]+").findall
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begins, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 20, "<u4"), 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(parts), 2000):
            found = self.model.encode(" ".join(parts[k : k + 2000]), add_special_tokens=False)
            ids, ends = np.array(found.ids, "<u4").tobytes(), (np.cumsum(np.bincount(found.word_ids)) * 4).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of printable Latin-1 characters."""
        flat = self.parts_of("\n".join(words).lower())
        missing = list(set(flat) - self.parts.keys() - {"\n"})
        if len(self.parts) + len(missing) > MOST_PARTS:
            self.parts.clear()
            missing = list(set(flat) - {"\n"})
        fresh = dict(zip(missing, self._encode_parts(missing)))
        self.parts.update(fresh)
        self.parts["\n"] = LINE
        out = b"".join(map(self.parts.__getitem__, flat)).split(LINE)
        for part in missing:
            if len(part) > LONGEST_PART:
                del self.parts[part]
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of new words; hashes come sorted."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, w in enumerate(texts) if self.plain(w)]
        ids: list[bytes] = [b""] * len(texts)
        for k, x in zip(plain, self._plain_ids([texts[k] for k in plain]) if plain else ()):
            ids[k] = x
        for k in set(range(len(texts))).difference(plain):
            ids[k] = self._whole(texts[k])
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        new = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(self.used + 2 * len(new) + (1 << 18), "<u4")))
        self.pool[self.used : self.used + len(new)] = new
        begins = self.used + np.cumsum(counts) - counts
        self.used += len(new)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begins = np.insert(self.begins, at, begins)
        self.counts = np.insert(self.counts, at, counts)

    def _cached(self, texts: list[bytes]) -> list[bytes]:
        joined, starts, ends, hashes, first = word_spans(texts, NOT_BLANK)
        if not len(hashes):
            return [b""] * len(texts)
        own, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(own) > MOST_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, own)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == own[known]
        if not known.all():
            new = example[~known]
            self._learn(own[~known], [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.hashes, own)
        at = at[which]
        counts = self.counts[at]
        last = np.cumsum(counts)
        ids = self.pool[np.repeat(self.begins[at] - (last - counts), counts) + np.arange(last[-1])]
        edges = np.concatenate(([0], last))[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        if not self.by_words:
            return [self._whole(t.decode("utf-8", "replace")) for t in texts]
        out: list[bytes] = []
        for begin, end in chunks(texts):
            own = texts[begin:end]
            odd = [k for k, t in enumerate(own) if b"<|" in t]
            found = self._cached([b"" if b"<|" in t else t for t in own])
            for k in odd:
                found[k] = self._whole(own[k].decode("utf-8", "replace"))
            out += found
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class CapacityTree:
    """A segment tree over remaining capacities 0 to `window`: which of them have an open window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        if not self.open[capacity]:
            k = self.size + capacity
            while k and not self.any[k]:
                self.any[k] = 1
                k >>= 1
        self.open[capacity].append(window_id)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take an open window of the least capacity of at least `need`: (capacity, id)."""
        tree, k = self.any, self.size + need
        while not tree[k]:
            while k & 1:  # a right child: everything further right hangs under an ancestor's sibling
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k *= 2
            if not tree[k]:
                k += 1
        capacity = k - self.size
        held = self.open[capacity]
        window_id = held.pop()
        if not held:
            while k and not (2 * k < len(tree) and (tree[2 * k] or tree[2 * k + 1])):
                tree[k] = 0
                k >>= 1
        return capacity, window_id


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset in it) of each length; lengths come longest first."""
    tree, numbers, offsets, used = CapacityTree(window), [], [], 0
    for n in lengths:
        found = tree.tightest(n)
        if found is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = found
        numbers.append(number)
        offsets.append(window - capacity)
        if capacity > n:
            tree.put(capacity - n, number)
    return numbers, offsets


def token_pieces(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row_ (and ids) of each piece of each document."""
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType)
    schema = schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("row_", "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    end = np.array([end_id], "<u4").tobytes()

    def cut(part: pa.RecordBatch) -> dict:
        texts = texts_of(part.column(text))
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, row, ids in zip(part.column("doc_id").to_pylist(), part.column("row_").to_pylist(), encoder(vocabulary).encode(texts)):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, window):
                own = ids[4 * start : 4 * (start + window)]
                values = (doc_id, start, len(own) // 4, zlib.crc32(own), total, row)
                for name, x in zip(out, values):
                    out[name].append(x)
                if with_ids:
                    out["ids"].append(np.frombuffer(own, "<u4"))
        return out

    rows = docs.select("doc_id", text, F.monotonically_increasing_id().alias("row_"))
    return map_texts(rows, text, cut, schema)


def pack_pieces(pieces: DataFrame, window: int = 4096, group: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` is read twice: write it first.

    sequence_id is the group's number times 2^32 plus the window's number in the group.
    """
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-n // max(group, MOST_PIECES)), min(-(-n // group), tokens // (WINDOWS * window)))
    dealt = pieces.withColumn("group_", F.pmod(F.xxhash64("row_", "start"), F.lit(groups)))
    schema = StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "row_", "start"], ascending=[False, True, True], ignore_index=True)
        numbers, offsets = best_fit(own["length"].tolist(), window)
        own["sequence_id"] = own["group_"].to_numpy() * (1 << 32) + np.array(numbers, np.int64)
        own["offset"] = np.array(offsets, np.int64)
        return own[[f.name for f in schema]]

    return dealt.groupBy("group_").applyInPandas(pack, schema).drop("row_")


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, window: int = 4096, end_id: int = 2, text: str = "text", with_ids: bool = False, group: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset of every piece."""
    pieces = scratch.keep(token_pieces(docs, vocabulary, window, end_id, text, with_ids), "pieces")
    return pack_pieces(pieces, window, group)


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Training rows: sequence_id, ids padded to the window, and the document number at each id.

    `packed` comes from pack(..., with_ids=True). Padding has document number 0.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p_"))
    ids = F.flatten(F.transform("p_", lambda p: p["ids"]))
    marks = F.flatten(F.transform("p_", lambda p, k: F.array_repeat((k + 1).cast("int"), F.size(p["ids"]))))
    padding = lambda a, x: F.concat(a, F.array_repeat(F.lit(x).cast("int"), (F.lit(window) - F.size(a)).cast("int")))
    return rows.select("sequence_id", padding(ids, pad_id).alias("ids"), padding(marks, 0).alias("documents"))
