"""The prefix trie against plain Python, with long, shared, empty and missing conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from tests.llm.conftest import rows_of
from wareflow.llm import trie
from wareflow.llm.trie import ordered_turns, prefix_trie, with_shared_heads

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, x long, position string, length string, block long, words string, n_convs long"


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children, ends, leaves, saved = defaultdict(int), defaultdict(list), defaultdict(int), defaultdict(int)
    for c in sorted(convs):
        ends[tuple(convs[c])].append(c)
    for path, own in members.items():
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((own[0], len(p), members[p[:-1]][0] if p else None, len(own), children[p], leaves[p], saved[p], digest(ends[p])) for p, own in members.items()),
        key=repr,
    )


def frame(spark, rows, partitions=3):
    full = [(*r, *[None] * 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def nodes(spark, scratch, rows):
    return prefix_trie(*with_shared_heads(ordered_turns(frame(spark, rows), scratch), scratch), scratch)


def made():
    draw = random.Random(5)
    said = [None, "", " \t", "a", "a b", "b\nc d", "A b", "ä ö ü"]
    rows = []
    for c in [*range(-45, 90), 10**15, 2**62 + 3]:
        for turn in range(draw.randrange(1, 7)):
            rows.append((c, turn * draw.choice([1, 10]), draw.choice([None, "", "u", "s"]), draw.choice(said[: draw.choice([2, 4, 8])])))
    return rows


def test_equal_to_plain_python(spark, scratch):
    rows = [r for r in made() if r[0] != 40]
    # a null turn, a turn that is there twice, a row without a conversation
    rows += [(101, None, "u", "first"), (101, 0, "u", "then"), (102, 1, "u", "twice"), (102, 1, "u", "twice"), (None, 1, "u", "lost"), (61, 3, "u", "gone")]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(102, 1, "u", "twice")]
    got = nodes(spark, scratch, rows)
    assert got.columns == ["x", "y", *COLUMNS]
    assert rows_of(got, *COLUMNS) == expected(rebuilt(rows))


def test_long_conversations_go_over_blocks(spark, scratch):
    line = [("u", f"word {k % 9}") for k in range(700)]
    convs = {1: line[:700], 2: line[:700], 3: line[:600], 4: line[:512] + [("u", "off")], 5: line[:256], 6: line[:257], 7: [("s", "x")], 8: [], 9: line[:300] + [("u", "y")] * 300, 10: line[:256]}
    assert trie.BLOCK == 256
    turns = spark.createDataFrame([(c, p, zlib.crc32(repr(t).encode()), 7, len(t[1].split())) for c, own in convs.items() for p, t in enumerate(own)], "conv_id long, position long, a long, b long, words long")
    lengths = spark.createDataFrame([(c, len(own)) for c, own in convs.items()], "conv_id long, length long")
    assert rows_of(prefix_trie(turns.repartition(5), lengths, scratch), *COLUMNS) == expected(convs)


def test_a_common_turn_over_many_partitions(spark, scratch):
    rows = [(c, t, "u", "hello you" if t < 2 else f"{c % 7} {t}") for c in range(400) for t in range(1 + c % 4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = rows_of(nodes(spark, scratch, rows), *COLUMNS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert got == expected(rebuilt(rows))


def test_no_conversations(spark, scratch):
    assert nodes(spark, scratch, []).count() == 0
    assert nodes(spark, scratch, [(None, 0, "u", "a")]).count() == 0


@pytest.mark.parametrize(("most", "rows"), [(1, 1), (3, 5), (4096, 1), (4096, 1 << 17)])
def test_shards_keep_conversations_whole(monkeypatch, most, rows):
    monkeypatch.setattr(trie, "CONVERSATIONS", most)
    monkeypatch.setattr(trie, "ROWS", rows)
    table = {"block": [], "conv_id": [], "position": []}
    for block, convs in ((0, range(9)), (1, range(3, 7)), (2, [5])):
        for c in convs:
            for p in [-1, *range(block * 256, block * 256 + c % 4 + (block > 0))]:
                for name, value in zip(table, (block, c, p)):
                    table[name].append(value)
    n = len(table["block"])
    table |= {c: [0] * n for c in ("x", "y", "words", "length")}
    batches = pa.RecordBatch.from_pydict(table)
    got = list(trie._shards(iter(batches.slice(k, 4) for k in range(0, n, 4))))
    assert [(s.depth, c) for s in got for c in s.ids] == [*((0, c) for c in range(9)), *((256, c) for c in range(3, 7)), (512, 5)]
    assert sum(int(s.n_turns.sum()) for s in got) == n - 14 and max(len(s.ids) for s in got) <= most
