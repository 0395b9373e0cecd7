"""The queries as they are registered: against SQL, brute force and held-out labels; and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import cell, connect, rows
from tests.llm.conftest import rows_of
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_hnsw import brute
from tests.llm.test_line_dedup import expected as without_lines
from tests.llm.test_near_duplicates import expected as components
from wareflow.llm.queries import QUERIES, VOCABULARY
from wareflow.llm.sql import ORACLE
from wareflow.llm.store import Scratch

SMALL = "/root/testdata/sf0.001"


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_equal_to_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    sql = connect(SMALL).execute(ORACLE[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns) and cell(None) == "NULL"
    assert rows(df.columns, df.collect()) == rows(names, sql.fetchall())


def test_packing(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op1_packing"](spark, SMALL).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc_id, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, crc, total in sorted(own):
            assert start == at and total == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] and sum(n for _, n in own) <= 4096


def test_sharding(spark):
    got = QUERIES["op2_sharding"](spark, SMALL).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {(a, b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32)} == {(k, len(t) + 8, zlib.crc32(t)) for k, t in docs.items()}


def test_nearest(spark):
    base = SMALL.replace("0.001", "0.01")
    table = spark.read.parquet(f"{base}/embeddings.parquet").collect()
    vectors, ids = np.array([r.embedding for r in table]), np.array([r.vec_id for r in table])
    found = defaultdict(set)
    for r in QUERIES["op4_nearest"](spark, base).collect():
        found[r.query_id].add(r.vec_id)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    assert np.mean([len(own & set(brute(vectors, ids, q, 10))) / 10 for q, own in found.items()]) >= 0.95


def test_the_stages_do_what_plain_python_does(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in sorted(docs.collect(), key=lambda r: r.doc_id)] if name != "packing" else docs
        out = scratch.keep(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id: r.text for r in out.collect()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "quality":
            judged = {r.doc_id for r in QUERIES["op7_quality"](spark, SMALL).collect() if r.predicted}
            assert after == {k: t for k, t in before if k in judged} and 100 < len(after) < len(before)
        elif name == "line_dedup":
            assert after == {k: t for k, *_, t in without_lines(before, 10)}
        elif name == "near_dedup":
            assert after == {k: t for (k, t), row in zip(before, sorted(components(before, 5, 80))) if row[3]}
        elif name == "decontaminate":
            bad = {row[0] for row in contaminated(before, items) if row[5]}
            assert after == {k: t for k, t in before if k not in bad}
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out


def test_the_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows_of(got, "doc_id")
