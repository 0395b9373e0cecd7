"""The prefix trie of conversations, by vertical bitmaps.

Method. In a shard, each (position, turn) has a bitset of the conversations that hold that turn there. A
node is the bitset of the conversations that begin with its turns. Depth first, a node's bitset is intersected
with the postings of the next position: the least conversation not yet covered names the posting, so
each intersection is a child. Popcounts are the sizes, and the bits of conversations whose length is
the depth are the ends.

At scale. Turns travel as two 64-bit hashes and a word count; texts are read once. A shard is a range of up
to CONVERSATIONS conversation ids and one block of BLOCK positions, so neither a common first turn nor an
endless conversation is ever in one task: such a node comes as one row from each shard, and a long
conversation starts each of its blocks with the hash of its path so far. A path's hash is the exclusive or
of the hashes of its (position, turn) pairs, which partial aggregation can add up.

Sums over subtrees need no walk over levels. Every node belongs to its least member, so a conversation
owns the last part of its path, from some depth s on. Over the subtree of a node v, the words that sharing
saves are those of each member c but the owner from v's depth to s(c) - 1, that is T(c) - P, where P are the words
before v and T(c) those before s(c). Leaves are counted by their owners. A second walk of the shards adds up T and the leaves
along the bitmaps.

Each node's end ids are chunks in ascending order, one of each shard that has some; they are hashed as they stream by.

Defined results
* Rows are ordered by turn, null first, and among equal turns by the turn's hash; repeated rows are turns of their own.
* null role or text: empty. Empty texts and turns are turns like others.
* null conv_id: no conversation; the row takes no part.
* A conversation without turns is a member of the root. No conversations: no nodes.
* Negative ids follow SQL: c - c % 20 is the multiple of 20 towards zero.
* Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareflow.llm.numbering import numbered
from wareflow.llm.store import Scratch

#: Positions of a block, conversations of a shard, rows that a task gathers before it builds shards.
BLOCK, CONVERSATIONS, ROWS = 256, 4096, 1 << 17
NODE = "depth long, x long, y long, px long, py long, n_convs long, conv_id long, words long, path_words long, ends binary, first_end long"
SUMS = "x long, y long, t long, n_leaves long"


def ordered_turns(conversations: DataFrame, scratch: Scratch, role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 0), a, b and words of each turn; a and b are halves of a hash of role and text."""
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat_ws(":", F.length(who), who, said), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").alias("a"),
        F.conv(F.substring(digest, 17, 16), 16, -10).cast("long").alias("b"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return numbered(scratch.keep(rows, "turns"), scratch, F.col("conv_id"), [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]).drop("turn")


def with_shared_heads(turns: DataFrame, scratch: Scratch, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every.

    h is the CRC-32 of c's decimal form modulo `most`. Returns the turns and (conv_id, length).
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    heads = turns.where((F.col("position") < most) & (F.col("conv_id") % every == 0))
    heads = heads.select(F.col("conv_id").alias("base"), F.struct("position", "a", "b", "words").alias("turn"))
    heads = heads.groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("head"))  # less than `most` turns
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, base).join(heads, "base", "left")
    convs = convs.select("conv_id", "n", "h", F.expr("slice(coalesce(head, array()), 1, CAST(h AS INT))").alias("head"))
    convs = scratch.keep(convs.withColumn("taken", F.size("head").cast("long")), "conversations")
    lent = convs.select("conv_id", F.inline("head"))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("position >= h")
    own = own.withColumn("position", F.col("position") - F.col("h") + F.col("taken")).select("conv_id", "position", "a", "b", "words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return lent.unionByName(own), lengths


def _blocks(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of the shards: the turns with their hashes, and where each conversation's blocks start."""
    x, y = F.xxhash64("position", "a", "b").alias("x"), F.xxhash64("b", "position", "a").alias("y")
    block = F.floor(F.col("position") / BLOCK).cast("long").alias("block")
    rows = scratch.keep(turns.select(block, "conv_id", "position", x, y, "words"), "rows")
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("words"))
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    before = {c: F.coalesce(f(c).over(so_far), F.lit(0)) for c, f in (("x", F.bit_xor), ("y", F.bit_xor), ("words", F.sum))}
    starts = sums.withColumns({**before, "total": F.sum("words").over(whole)})
    none = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("block", "x", "y", "words", "total")}
    starts = lengths.join(starts, "conv_id", "left").withColumns({**none, "position": F.lit(-1).cast("long")})
    return rows, scratch.keep(starts, "starts")


class Shard:
    """Conversations of a range of ids in one block of positions."""

    def __init__(self, columns: dict[str, np.ndarray]):
        begin = np.flatnonzero(columns["position"] < 0)
        self.depth = int(columns["block"][0]) * BLOCK
        self.first = begin + 1
        self.n_turns = np.diff(np.append(begin, len(columns["position"]))) - 1
        self.ids = columns["conv_id"][begin].tolist()
        self.starts = list(zip(columns["x"][begin].tolist(), columns["y"][begin].tolist(), columns["words"][begin].tolist()))
        self.columns, self.begin = columns, begin
        self.keys = list(zip(columns["x"].tolist(), columns["y"].tolist()))
        self.words = columns["words"].tolist()

    def at_depth(self, depths: np.ndarray) -> dict[int, int]:
        """The bitset of the conversations for each depth."""
        out: dict[int, int] = defaultdict(int)
        for c, d in enumerate(depths.tolist()):
            out[d] |= 1 << c
        return out

    def walk(self) -> Iterator[tuple[int, int, int, int, int, int, int, int, int]]:
        """Nodes depth first: number of the parent (or -1), depth, bitset, path hash, parent's path hash, words, words of the path.

        The first block begins with the root; the others begin below nodes of the block before.
        """
        postings: dict[tuple[int, int, int], int] = defaultdict(int)
        alive = [0] * int(self.n_turns.max())
        for c, (first, n) in enumerate(zip(self.first.tolist(), self.n_turns.tolist())):
            bit = 1 << c
            for j in range(n):
                postings[(j, *self.keys[first + j])] |= bit
                alive[j] |= bit
        groups: dict[tuple[int, int, int], int] = defaultdict(int)
        for c, start in enumerate(self.starts):
            groups[start] |= 1 << c
        stack, made, first = [], 0, self.first.tolist()
        for (x, y, path_words), bits in groups.items():
            if self.depth == 0:
                yield -1, 0, bits, x, y, 0, 0, 0, 0
                made += 1
            stack.append((made - 1 if self.depth == 0 else -1, 0, bits, x, y, path_words))
        while stack:
            parent, j, bits, x, y, path_words = stack.pop()
            rest = bits & alive[j] if j < len(alive) else 0
            while rest:
                c = (rest & -rest).bit_length() - 1
                kx, ky = self.keys[first[c] + j]
                child = bits & postings[j, kx, ky]
                rest ^= child
                words = self.words[first[c] + j]
                yield parent, self.depth + j + 1, child, x ^ kx, y ^ ky, x, y, words, path_words + words
                stack.append((made, j + 1, child, x ^ kx, y ^ ky, path_words + words))
                made += 1

    def members(self, bits: int) -> Iterator[int]:
        """Numbers of the conversations of a bitset, ascending."""
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def nodes(self) -> list[tuple]:
        """Rows of NODE."""
        ending = self.at_depth(self.columns["length"][self.begin])
        out = []
        for _, depth, bits, x, y, px, py, words, path_words in self.walk():
            first = self.ids[(bits & -bits).bit_length() - 1]
            here = bits & ending.get(depth, 0)
            ids = [self.ids[c] for c in self.members(here)]
            above = (px, py) if depth else (None, None)
            out.append((depth, x, y, *above, bits.bit_count(), first, words, path_words, ",".join(map(str, ids)).encode() if ids else None, ids[0] if ids else None))
        return out

    def sums(self) -> list[tuple]:
        """Rows of SUMS: T of the members that don't own the node, and leaves that members own."""
        own, t, leaf = (self.columns[c][self.begin] for c in ("owned_from", "t", "leaf"))
        out_of = self.depth + self.n_turns
        entering = self.at_depth(np.minimum(own - 1, out_of))
        leaving = self.at_depth(out_of)
        leaves = sum(1 << c for c in np.flatnonzero(leaf).tolist())
        values, rows, above = t.tolist(), [], []
        for parent, depth, bits, x, y, *_ in self.walk():
            here = sum(values[c] for c in self.members(bits & entering.get(depth, 0)))
            rows.append([x, y, here, (bits & leaving.get(depth, 0) & leaves).bit_count()])
            above.append(parent)
        for k in range(len(rows) - 1, -1, -1):
            if above[k] >= 0:
                rows[above[k]][2] += rows[k][2]
                rows[above[k]][3] += rows[k][3]
        return [tuple(r) for r in rows]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Cut rows sorted by block, conversation and position into shards; each conversation is whole."""
    held: dict[str, np.ndarray] | None = None
    for batch in _then_none(batches):
        if batch is not None:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            held = new if held is None else {c: np.concatenate((held[c], new[c])) for c in new}
        if held is None or (batch is not None and len(held["position"]) < ROWS):
            continue
        begin = np.flatnonzero(held["position"] < 0)
        # The last conversation may go on in the next batch.
        edges = np.append(begin, len(held["position"])) if batch is None else begin
        cuts, at = [0], 0
        for k in range(1, len(edges)):
            new_block = edges[k] < len(held["block"]) and held["block"][edges[k]] != held["block"][edges[k] - 1]
            if new_block or k - at >= CONVERSATIONS or k == len(edges) - 1:
                cuts.append(int(edges[k]))
                at = k
        for a, b in zip(cuts, cuts[1:]):
            yield Shard({c: v[a:b] for c, v in held.items()})
        held = {c: v[cuts[-1] :] for c, v in held.items()} if batch is not None else None


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _grown(rows: DataFrame, schema: str, what: str) -> DataFrame:
    keys = ["block", "conv_id", "position"]
    names = [part.split()[0] for part in schema.split(", ")]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary() if " binary" in part else pa.int64() for part in schema.split(", ")]
        for shard in _shards(batches):
            found = getattr(shard, what)()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=names)

    return rows.repartitionByRange("block", "conv_id").sortWithinPartitions(*keys).mapInArrow(grow, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's chunks, joined by commas; rows come sorted by path and first id."""
    path, state = None, None
    for batch in batches:
        done = []
        for x, y, ends in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ends"))):
            if (x, y) == path:
                state.update(b",")
            else:
                if state is not None:
                    done.append((*path, state.hexdigest()))
                path, state = (x, y), hashlib.sha256()
            state.update(ends)
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([(*path, state.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done)], names=["x", "y", "ends_sha256"])


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each node: its path's hash (x, y), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, position from 0 without gaps, a and b (what makes turns equal) and words. lengths:
    conv_id and number of turns of every conversation, those without turns too. Both are read several times.
    """
    rows, starts = _blocks(turns, lengths, scratch)
    empty = F.lit(None).cast("long")
    begins = starts.select("block", "conv_id", "position", "x", "y", "words", "length")
    parts = scratch.keep(_grown(rows.withColumn("length", F.lit(0).cast("long")).unionByName(begins), NODE, "nodes"), "parts")
    same = [F.any_value(c).alias(c) for c in ("depth", "px", "py", "words", "path_words")]
    nodes = parts.groupBy("x", "y").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = scratch.keep(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, ["x", "y"], "left").fillna(0, ["n_children"]), "families")

    before = (F.col("path_words") - F.col("words")).alias("t")
    top = F.min(F.struct("depth", "x", "y", "px", "py", before)).alias("top")
    owners = scratch.keep(nodes.groupBy("conv_id").agg(top, F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "owners")
    never = F.lit((1 << 62)).cast("long")
    begins = starts.join(owners, "conv_id", "left").select(
        "block", "conv_id", "position", "x", "y", "words",
        F.coalesce("top.depth", never).alias("owned_from"),
        F.coalesce("top.t", "total").alias("t"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"),
    )
    walked = rows.withColumns({c: F.lit(0).cast("long") for c in ("owned_from", "t", "leaf")}).unionByName(begins)
    sums = _grown(walked, SUMS, "sums").groupBy("x", "y").agg(F.sum("t").alias("t"), F.sum("n_leaves").alias("n_leaves"))

    ends = parts.where("ends IS NOT NULL").select("x", "y", "first_end", "ends")
    ends = ends.repartition("x", "y").sortWithinPartitions("x", "y", "first_end").mapInArrow(_digests, "x long, y long, ends_sha256 string")
    # Below the top of what a conversation owns, parent and child have the same owner.
    tops = owners.where("top.depth > 0").select("top.x", "top.y", F.col("top.px").alias("px"), F.col("top.py").alias("py"))
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("owner_above"))
    tops = tops.join(above, ["px", "py"]).select("x", "y", "owner_above")
    found = nodes.join(sums, ["x", "y"], "left").join(ends, ["x", "y"], "left").join(tops, ["x", "y"], "left")
    return found.select(
        "x", "y", "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("owner_above", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves",
        (F.col("t") - (F.col("n_convs") - 1) * (F.col("path_words") - F.col("words"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
