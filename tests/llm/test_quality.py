"""Quality scores: the discriminant against a plain one, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from wareflow.llm import quality
from wareflow.llm.queries import op7_quality

WORDS = ["stone", "river", "quiet", "morning", "walked", "along", "garden", "letter", "window", "house", "a", "the", "of", "to"]


def clean(rng):
    n = rng.randint(2, 12)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 14))).capitalize() + "." for _ in range(n))


def junk(rng):
    kind = rng.randrange(3)
    words = [rng.choice(WORDS) for _ in range(rng.randint(20, 90))]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words) if kind == 1 else " | ".join(words[:6] * 12)


def corpus(n, seed):
    rng = random.Random(seed)
    rows = [(k, junk(rng) if k % 5 == 2 else clean(rng)) for k in range(n)]
    return rows, [(k, 0 if k % 5 == 2 else 1, 0) for k in range(n)]


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id LONG, quality INT, toxic INT, text STRING, label STRING")


def test_held_out_rows_are_told_apart(spark, documents, scratch):
    rows, known = corpus(600, 1)
    got = quality.classify(documents(rows), labels(spark, known), scratch).collect()
    assert {r.doc_id for r in got} == set(range(600))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 != 2) for r in held]) > 0.97


def test_held_out_labels_change_nothing(spark, documents, scratch):
    rows, known = corpus(200, 2)
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in known]
    one, two = (
        {r.doc_id: r.score for r in quality.classify(documents(rows), labels(spark, x), scratch).collect()} for x in (known, turned)
    )
    assert one == pytest.approx(two, abs=1e-9)


def test_moments_and_evidence_are_those_of_plain_formulas(spark, documents, scratch):
    rows, known = corpus(150, 3)
    x = quality.features([t.encode() for _, t in rows])
    y = np.array([q for _, q, _ in known])
    train = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k, _ in rows])
    model = quality.fit(quality.statistics(documents(rows)), labels(spark, known), scratch)
    for c in (0, 1):
        assert model.counts[c] == (y[train] == c).sum()
        assert model.means[c] == pytest.approx(x[train][y[train] == c].mean(axis=0))
    got = model.evidence(x[:5])
    parts = []
    for c in (0, 1):
        inverse = model.factors[c]
        covariance = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        z = (x[:5] - model.means[c]) / model.scale
        parts.append(-0.5 * (np.einsum("nd,nd->n", z @ np.linalg.inv(covariance), z) + np.linalg.slogdet(covariance)[1]))
    assert got == pytest.approx(parts[1] - parts[0], rel=1e-6)


def test_a_text_is_measured_the_same_in_any_batch():
    texts = [b"", b"One two.", b"A A A\nB!!", "é ü ß".encode(), b"word " * 400_000, b"\n\n", b"One two."]
    together = quality.features(texts)
    assert np.isfinite(together).all()
    for text, row in zip(texts, together):
        assert quality.features([text])[0] == pytest.approx(row)


def test_odd_rows(spark, documents, scratch):
    rows, known = corpus(100, 4)
    rows += [(None, None), (None, "x"), (500, ""), (500, ""), (501, None), (502, "word " * 100_000)]
    known += [(None, 0, 0), (500, None, 0), (502, 7, 0), (3, 1, 0)]
    got = quality.classify(documents(rows), labels(spark, known), scratch).collect()
    assert len(got) == 106 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    empty = {r.score for r in got if r.doc_id in (500, 501)}
    assert len(empty) == 1


def test_one_class_no_labels_and_no_rows(spark, documents, scratch):
    rows, known = corpus(30, 5)
    ones = [(k, 1, 0) for k, _, _ in known]
    assert {r.score for r in quality.classify(documents(rows), labels(spark, ones), scratch).collect()} == {1.0}
    assert {r.score for r in quality.classify(documents(rows), labels(spark, []), scratch).collect()} == {0.5}
    assert quality.classify(documents([]), labels(spark, known), scratch).count() == 0


def test_accepted_rows_keep_their_columns(spark, documents, scratch):
    rows, known = corpus(200, 6)
    docs = documents(rows)
    model = quality.fit(quality.statistics(docs), labels(spark, known), scratch)
    measured, name = quality.with_features(docs)
    assert name == "features_"  # the table has a column of that name
    kept = quality.accepted(measured, model, name)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.scored(quality.statistics(docs), model).collect() if r.predicted}


def test_supplied_documents(spark):
    base = "/root/testdata/sf0.01"
    got = op7_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 50 and right >= 0.95
