"""Near-duplicate documents by tensored MinHash banding, verified on full shingle sets.

Method. A document has two small collections of keys, `side` keys each of `width` minhashes. A table
is a pair of them, one from each collection, so side^2 tables of 2*width minhashes each cost only
2*side*width minhash computations per shingle. Two documents are candidates if they meet in a
table. At similarity s they are missed with probability of about 2*(1 - s^width)^side: for the
defaults 1.7e-6 at 0.8 and less above.

1. Shingle sets are hashed once per row to a digest of the whole set and the two key collections.
   Rows with equal sets are one class and go on as one.
2. A key that no other class has cannot make a table meet. Only keys that are shared are paired,
   so a class without relatives costs 2*side narrow rows and not side^2.
3. In each table bucket every class is linked to the least one: a star, never all pairs. The
   components of these stars are candidate groups; whatever met in a table is in one group.
4. Texts that share a template chain to groups that are much larger than what is alike in them. A group of CHAIN
   blocks or more is therefore cut by an exact condition first: two sets with the wanted similarity share one of
   the shingles that are rarest in the group, among as many of each set as the similarity allows to differ, and one.
   Texts that have a fifth of their own beside the template then meet nobody, so work
   follows what may be alike and not the size of the chain.
5. A group's texts come together in blocks of bounded size, each pair of blocks once, and sets are
   compared exactly, skipping pairs that are already connected. A pair of blocks emits at
   most a spanning forest of its links.
6. Components of the verified links are the result.

Defined results
* null, empty or blank text: no shingles, linked with nothing; it is a component of itself.
* Fewer words than a shingle: the whole sequence is the one shingle.
* null id: takes part in links, never names a component; a component with null ids only has a
  null component_id; `kept` is false there.
* Repeated rows and repeated ids: each row is reported; all rows with the component's id are kept.
* Ties can't arise: the smallest id names a component. An empty table gives an empty result.
* Other columns are not read.
* Sets are compared by 64-bit shingle hashes, classes by a 128-bit digest of the set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.llm.components import components
from wareflow.llm.rows import map_texts, text_key, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import U, mix, shingle_sets

#: Texts of groups go to every task's filter up to so many classes; more are joined.
MOST_SENT = 200_000
#: Shingles and classes of a block, and blocks of a group from which on it is cut before it is compared.
BLOCK_SHINGLES, BLOCK_CLASSES, CHAIN = 500_000, 2_000, 5


def minhash_keys(sets: list[np.ndarray], side: int, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The two key collections of each set, as (sets, side) arrays; sets must not be empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    sides = []
    for collection in range(2):
        keys = np.empty((len(sets), side), U)
        for k in range(side):
            key = np.full(len(sets), collection * side + k, U)
            for w in range(width):
                salt = mix(np.array([((seed * 2 + collection) * side + k) * width + w + 1], U))[0]
                values = (flat ^ salt) * (salt | U(1))
                values ^= values >> U(32)
                values *= U(0xD6E8FEB86659FD93)
                key = mix(key * U(0xD1342543DE82EF95) + np.minimum.reduceat(values, first))
            keys[:, k] = key
        sides.append(keys.view(np.int64))
    return sides[0], sides[1]


def signatures(docs: DataFrame, text: str, shingle: int, side: int, width: int) -> DataFrame:
    """doc_id, row_, n_shingles, digest (null without shingles), left and right keys of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(texts_of(part.column(text)), shingle)
        some = [s for s in sets if len(s)]
        left, right = minhash_keys(some, side, width) if some else ((), ())
        rows = iter(zip(left, right))
        keys = [next(rows) if len(s) else (None, None) for s in sets]
        return {
            "doc_id": part.column("doc_id"),
            "row_": part.column("row_"),
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "left": [k[0] for k in keys],
            "right": [k[1] for k in keys],
        }

    schema = f"doc_id {kind}, row_ long, n_shingles long, digest binary, left array<long>, right array<long>"
    return map_texts(docs.select("doc_id", text, text_key(F.col(text)).alias("row_")), text, sign, schema)


def table_stars(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): classes that met in a table with the least class there."""
    keys = classes.select("id", F.explode(F.concat(
        F.transform("left", lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))),
        F.transform("right", lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))),
    )).alias("k")).select("id", "k.side", "k.key")
    shared = keys.groupBy("side", "key").agg(F.count("*").alias("n")).where("n > 1").select("side", "key")
    both = keys.join(shared, ["side", "key"]).groupBy("id").agg(
        F.collect_list(F.expr("CASE WHEN side = 0 THEN key END")).alias("left"),
        F.collect_list(F.expr("CASE WHEN side = 1 THEN key END")).alias("right"),
    )
    tables = both.select("id", F.explode("left").alias("l"), "right")
    tables = tables.select("id", "l", F.explode("right").alias("r"))
    tables = scratch.keep(tables, "tables")
    least = tables.groupBy("l", "r").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = tables.join(least.drop("n"), ["l", "r"]).where("id <> b")
    return met.select(F.col("id").alias("a"), "b").distinct()


def forest_of_links(sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of a block, or between those of two blocks.

    Linked: 100 * intersection >= percent * union.
    """
    across = block.min() != block.max()
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    label = np.arange(len(sets))
    mark = np.zeros(flat.max() + 1, bool)
    out: list[tuple[int, int]] = []
    todo = np.argsort(sizes, kind="stable")[::-1]
    for at, u in enumerate(todo):
        if across and block[u] == block.min():
            continue
        near = todo if across else todo[at + 1 :]
        near = near[(label[near] != label[u]) & (100 * np.minimum(sizes[near], sizes[u]) >= percent * np.maximum(sizes[near], sizes[u]))]
        if across:
            near = near[block[near] != block[u]]
        if not len(near):
            continue
        mark[flat[first[u] : first[u] + sizes[u]]] = True
        if 4 * sizes[near].sum() > len(flat):
            common = np.add.reduceat(mark[flat], first, dtype=np.int64)[near]
        else:
            begin = np.cumsum(sizes[near]) - sizes[near]
            take = np.repeat(first[near] - begin, sizes[near]) + np.arange(sizes[near].sum())
            common = np.add.reduceat(mark[flat[take]], begin, dtype=np.int64)
        mark[flat[first[u] : first[u] + sizes[u]]] = False
        for v in near[100 * common >= percent * (sizes[near] + sizes[u] - common)]:
            if label[v] != label[u]:
                label[label == label[v]] = label[u]
                out.append((int(u), int(v)))
    return out


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each class in a task: rows that are repeated as a whole don't travel."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for name in batch.column("id").to_pylist():
            new.append(name not in seen)
            seen.add(name)
        yield batch.filter(pa.array(new))


def _blocks_of(s: str, n: str) -> Column:
    """Blocks that a group of n classes with s shingles is cut to."""
    return F.greatest(F.ceil(F.col(s) / BLOCK_SHINGLES), F.ceil(F.col(n) / BLOCK_CLASSES))


def _member_texts(docs: DataFrame, text: str, placed: DataFrame, few: bool) -> DataFrame:
    """The columns of placed and the text of a row of each class; placed has the row's id_ and key_."""
    names = [c for c in placed.columns if c not in ("id_", "key_")]
    if few:
        placed = F.broadcast(placed)
    rows = docs.select("doc_id", text_key(F.col(text)).alias("row_"), F.col(text).cast("binary").alias("text"))
    held = rows.join(placed, rows["doc_id"].eqNullSafe(placed["id_"]) & (rows["row_"] == placed["key_"])).select(*names, "text")
    return held.mapInArrow(_first_rows, held.schema)


def without_chains(docs: DataFrame, text: str, shingle: int, percent: int, members: DataFrame, scratch: Scratch) -> DataFrame:
    """members with groups of CHAIN blocks or more cut to the parts that can have links at all.

    A set of n shingles that is linked to another has at least percent * n / 100 of them in common with it. So at
    most n less that many are not common, and of one more than those, the rarest in the group by one order, some is in both
    sets' rarest ones. Classes that share none of theirs with anyone leave.
    """
    size = members.groupBy("group").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    large = scratch.keep(size.where(_blocks_of("s", "n") >= CHAIN).select("group", "n"), "large")
    n, groups = large.agg(F.sum("n"), F.count("*")).first()
    if not n:
        return members
    if groups <= MOST_SENT:
        large = F.broadcast(large)
    chained = members.join(large.select("group"), "group", "left_semi")
    placed = chained.select("id", "group", F.col("row.doc_id").alias("id_"), F.col("row.row_").alias("key_"))

    def cut(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(texts_of(part.column("text")), shingle)
        return {"id": part.column("id"), "group": part.column("group"), "s": [x.view(np.int64) for x in sets]}

    sets = map_texts(_member_texts(docs, text, placed, n <= MOST_SENT).dropDuplicates(["id"]), "text", cut, "id long, `group` long, s array<long>")
    flat = scratch.keep(sets.select("id", "group", F.explode("s").alias("s")), "shingles")
    shared = flat.groupBy("group", "s").agg(F.count("*").alias("df")).where("df > 1")
    rare = flat.join(shared, ["group", "s"]).groupBy("id", "group").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    rare = rare.join(members.select("id", "n_shingles"), "id")
    # Shingles that no other class has are the rarest and fill the first places.
    places = F.expr(f"n_shingles - (n_shingles * {percent} + 99) DIV 100 + 1 - (n_shingles - size(shared))")
    rare = rare.select("id", "group", F.explode(F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))).alias("p"))
    rare = scratch.keep(rare.select("id", "group", "p.s"), "rare")
    least = rare.groupBy("group", "s").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = rare.join(least, ["group", "s"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    parts = components(stars, scratch)
    parts = parts.union(parts.select("b", "b").distinct()).toDF("id", "part")
    scratch.drop(flat, rare)
    cut_up = chained.join(parts, "id").select("id", "n_shingles", "row", F.col("part").alias("group"))
    return members.join(large.select("group"), "group", "left_anti").select("id", "n_shingles", "row", "group").union(cut_up)


def verified_links(docs: DataFrame, text: str, shingle: int, percent: int, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the true links in each candidate group.

    members: id, n_shingles and group of the classes in a group, with `row` = (doc_id, row_) of
    a row that has the class's set. Small groups share a bin of about one block, larger ones are
    cut into blocks.
    """
    size = members.groupBy("group").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    total = size.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    bins = 1 + (total.s or 0) // BLOCK_SHINGLES + (total.n or 0) // BLOCK_CLASSES
    # Few groups have more than a block; what goes to every task is counted first.
    several = scratch.keep(size.select("group", _blocks_of("s", "n").alias("blocks")).where("blocks > 1"), "several")
    if several.limit(MOST_SENT + 1).count() <= MOST_SENT:
        several = F.broadcast(several)
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    placed = members.join(several, "group", "left").select(
        "id",
        "group",
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).alias("block"),
        F.col("row.doc_id").alias("id_"),
        F.col("row.row_").alias("key_"),
    )
    held = _member_texts(docs, text, placed, (total.n or 0) <= MOST_SENT)
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    pairs = pairs.select(
        F.when(alone, F.pmod(F.xxhash64("group"), F.lit(bins))).alias("bin"),
        F.when(~alone, F.col("group")).alias("large"),
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        "group",
        "block",
        "id",
        "text",
    )

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("id").sort_values("group", ignore_index=True)
        sets = shingle_sets(part["text"].tolist(), shingle)
        names, block = part["id"].tolist(), part["block"].to_numpy()
        across = part["x"].iloc[0] != part["y"].iloc[0]
        edges = [0, *(np.flatnonzero((part["group"] != part["group"].shift()).to_numpy()[1:]) + 1).tolist(), len(part)]
        found: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if b - a > 1 and (not across or len(set(block[a:b])) > 1):
                found += [(names[a + u], names[a + v]) for u, v in forest_of_links(sets[a:b], block[a:b], percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.groupBy("bin", "large", "x", "y").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", shingle: int = 5, percent: int = 80, side: int = 20, width: int = 3) -> DataFrame:
    """doc_id, row_, n_shingles, component_id, kept and chosen of every row.

    row_ is the text's key. `chosen` is true for one document of each component, also where ids are
    null or repeated with other texts: the first by id, nulls last, and then by text key.
    """
    rows = scratch.keep(signatures(docs, text, shingle, side, width), "signatures")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_")).alias("row"),
        F.count("*").alias("copies"),
        F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("left").alias("left"),
        F.any_value("right").alias("right"),
    )
    # A written number is a shorter name of a class than its digest, and one that hashes well.
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = components(table_stars(classes, scratch), scratch)
    groups = groups.union(groups.select("b", "b").distinct()).toDF("id", "group")
    members = scratch.keep(classes.select("id", "n_shingles", "row").join(groups, "id"), "members")
    members = scratch.keep(without_chains(docs, text, shingle, percent, members, scratch), "parts")
    linked = components(verified_links(docs, text, shingle, percent, members, scratch), scratch)
    named = classes.select("id", "digest", "row", "copies").join(linked.toDF("id", "root"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    first = named.groupBy("root").agg(F.min("row").alias("first"), F.sum("copies").alias("rows"))
    # Only rows with a relative look up their component; hot classes are split by adaptive execution.
    named = named.join(first.where("rows > 1").drop("rows"), "root").select("digest", "first")
    named = scratch.keep(named, "components")
    out = rows.select("doc_id", "row_", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_") == F.col("first.row_")))
    out = out.select("doc_id", "row_", "n_shingles", component.alias("component_id"), chosen.alias("chosen"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
