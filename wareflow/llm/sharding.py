"""A uniform shuffle into shards of exact sizes, in DataFrame functions only.

Method: hypergeometric communication matrix. Each partition's rows are permuted where they are and
numbered. How many rows each partition sends to each shard is drawn exactly from the multivariate
hypergeometric distribution with the partitions' sizes and the shards' sizes as margins. A partition's
first rows in its permuted order then go to shard 0, the next to shard 1 and so on. After the exchange each
shard is permuted again. All assignments with the given shard sizes are equally likely.

Law `rows`: shard sizes differ by one at most.

The draw is a fold over partition sizes, which are counts and not rows. Above `fan` partitions it goes
in two levels: first between groups of `fan` partitions, then inside every group in parallel. One scalar
draw inverts the distribution function outwards from the mode, to where double precision ends.

Defined results
* null text: empty, of size 8. null ids, repeated rows and repeated ids are rows like others.
* Ties of random keys go to the row's number, so slots have no gaps.
* Fewer rows than shards: the last shards are empty. An empty table gives an empty result.
* Other columns are not read; a text of any length is only measured and checksummed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareflow.llm.store import Scratch

#: Sizes that one fold goes through.
FAN = 512
#: Cells of the matrix that are sent to every task; a larger one is joined.
MOST_SENT = 1_000_000
#: Rows of one sorted run within a shard.
RUN = 4_096


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that only depends on the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, _long(0), lambda a, x: a + x)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` of `total` rows are among the `marked` ones, by inversion of u.

    Probabilities relative to the mode's follow from the ratio of neighbours, so nothing has to
    be normalised beforehand: one fold adds them up, a second one finds where u falls.
    """
    given = F.struct(*(x.cast("double").alias(a) for x, a in ((total, "n"), (marked, "k"), (drawn, "m"), (u, "u"))))
    return let(given, lambda g: let(_bounds(g), _invert))


def _bounds(g: Column) -> Column:
    n, k, m = g["n"], g["k"], g["m"]
    low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(m, k)
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")
    some = F.greatest(n, F.lit(1.0))
    spread = F.sqrt(m * (k / some) * ((n - k) / some))
    return F.struct(
        n.alias("n"), k.alias("k"), m.alias("m"), g["u"].alias("u"), low.alias("low"), high.alias("high"),
        F.least(high, F.greatest(low, mode)).alias("mode"), (_long(F.ceil(spread * 9)) + 30).alias("steps"),
    )


def _invert(b: Column) -> Column:
    n, k, m, mode = b["n"], b["k"], b["m"], b["mode"]
    steps, zero, one = F.sequence(_long(1), b["steps"]), F.lit(0.0), F.lit(1.0)

    def neighbours(state: Column, step: Column) -> Column:
        up, down = mode + step, mode - step
        rise = state["up"] * (k - up + 1) * (m - up + 1) / (up * (n - k - m + up))
        fall = state["down"] * (down + 1) * (n - k - m + down + 1) / ((k - down) * (m - down))
        return F.struct(F.when(up <= b["high"], rise).otherwise(zero).alias("up"), F.when(down >= b["low"], fall).otherwise(zero).alias("down"))

    def add(state: Column, step: Column) -> Column:
        return let(neighbours(state, step), lambda x: F.struct(x["up"].alias("up"), x["down"].alias("down"), (state["sum"] + x["up"] + x["down"]).alias("sum")))

    def find(state: Column, step: Column) -> Column:
        def move(x: Column) -> Column:
            at = F.when(state["at"] >= 0, state["at"]).when(state["left"] < x["up"], mode + step)
            at = at.when(state["left"] < x["up"] + x["down"], mode - step).otherwise(F.lit(-1.0))
            return F.struct(x["up"].alias("up"), x["down"].alias("down"), (state["left"] - x["up"] - x["down"]).alias("left"), at.alias("at"))

        return let(neighbours(state, step), move)

    def search(whole: Column) -> Column:
        target = b["u"] * whole
        begin = F.struct(one.alias("up"), one.alias("down"), (target - 1).alias("left"), F.when(target < 1, mode).otherwise(F.lit(-1.0)).alias("at"))
        return F.aggregate(steps, begin, find, lambda s: F.when(s["at"] >= 0, s["at"]).otherwise(mode))

    whole = F.aggregate(steps, F.struct(one.alias("up"), one.alias("down"), one.alias("sum")), add, lambda s: s["sum"])
    return let(whole, search).cast("long")


def draw_row(room: Column, rows: Column, shards: int, *key: Column) -> Column:
    """How many of `rows` rows go to each shard, where the shards have `room` left."""

    def draw(state: Column, shard: Column) -> Column:
        here = F.element_at(room, shard + 1)
        taken = hypergeometric(state["room"], here, state["rows"], _uniform(*key, shard))
        return let(taken, lambda t: F.struct((state["rows"] - t).alias("rows"), (state["room"] - here).alias("room"), F.array_append(state["out"], t).alias("out")))

    begin = F.struct(_long(rows).alias("rows"), _sum(room).alias("room"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, draw, lambda s: s["out"])


def draw_matrix(room: Column, sizes: Column, shards: int, *key: Column) -> Column:
    """A row of shard counts for each of `sizes` (structs of id and n), which sum to `room`."""

    def fold(state: Column, part: Column) -> Column:
        row = draw_row(state["room"], part["n"], shards, *key, part["id"])
        return let(row, lambda r: F.struct(
            F.zip_with(state["room"], r, lambda a, x: a - x).alias("room"),
            F.array_append(state["out"], F.struct(part["id"].alias("id"), r.alias("counts"))).alias("out"),
        ))

    begin = F.struct(room.alias("room"), F.array().cast("array<struct<id:bigint,counts:array<bigint>>>").alias("out"))
    return F.aggregate(sizes, begin, fold, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int, fan: int = FAN) -> DataFrame:
    """(id, counts): how many rows partition `id` sends to each shard. sizes: id and n."""
    grouped = sizes.groupBy(F.floor(F.col("id") / fan).alias("group")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("id", "n"))).alias("parts"))
    total = grouped.agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct(F.col("group").alias("id"), "n"))).alias("groups"))
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    room = F.transform(numbers, lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, _long(1)).otherwise(_long(0)))
    first = total.select(F.explode(draw_matrix(room, F.col("groups"), shards, F.lit(seed), F.lit("group"))).alias("g"))
    first = first.select(F.col("g.id").alias("group"), F.col("g.counts").alias("room"))
    cells = first.join(grouped, "group").select(F.explode(draw_matrix(F.col("room"), F.col("parts"), shards, F.lit(seed), F.lit("part"))).alias("p"))
    return cells.select("p.id", "p.counts")


def permuted(df: DataFrame, seed: int) -> DataFrame:
    """df with part_ and place_: each row's partition and its place in a random order of it."""
    mixed = df.withColumn("key_", F.rand(seed)).sortWithinPartitions("key_").drop("key_")
    number = F.monotonically_increasing_id()
    return mixed.withColumn("row_", number).withColumns({
        "part_": F.shiftright("row_", 33),
        "place_": F.col("row_").bitwiseAND(F.lit((1 << 33) - 1)),
    })


def shuffle_to_shards(df: DataFrame, scratch: Scratch, shards: int, seed: int = 7) -> DataFrame:
    """All rows of df with `shard` and `slot`, the row's place in its shard, gapless from 0.

    The locally permuted rows are written once, with all columns of df: pass what the shards hold.
    """
    rows = scratch.keep(permuted(df, seed), "permuted")
    sizes = rows.groupBy(F.col("part_").alias("id")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: _sum(F.slice("counts", 1, s)))
    matrix = scratch.keep(matrix.select(F.col("id").alias("part_"), ends.alias("ends_")), "matrix")
    cells = matrix.count() * shards
    assigned = rows.join(F.broadcast(matrix) if cells <= MOST_SENT else matrix, "part_")
    assigned = assigned.withColumn("shard", F.size(F.filter("ends_", lambda e: e <= F.col("place_"))))
    total = sum(r.n for r in sizes.agg(F.sum("n").alias("n")).collect() if r.n)
    runs = max(1, -(-total // (shards * RUN)))
    key = F.xxhash64(F.lit(seed), F.lit("again"), "row_")
    assigned = assigned.withColumn("again_", key).withColumn("run_", F.floor(_uniform(F.col("again_")) * runs))
    before = Window.partitionBy("shard").orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = assigned.groupBy("shard", "run_").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "run_", F.coalesce(F.sum("n").over(before), _long(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("shard", "run_").orderBy("again_", "row_"))
    placed = assigned.withColumn("inside_", inside).join(offsets, ["shard", "run_"])
    return placed.select(*df.columns, "shard", (F.col("before_") + F.col("inside_") - 1).alias("slot"))


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size and text_crc32 of every row."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = F.octet_length(body).cast("long") + 8
    return docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in order of slot."""
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
