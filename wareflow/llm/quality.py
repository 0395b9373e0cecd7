"""Quality scores of texts by a regularised quadratic discriminant.

Method. A text becomes a vector of transformed statistics of its bytes, words and lines. Each class
has a mean and a covariance that is shrunk towards the pooled covariance and a scaled identity. A text's
evidence is the difference of the two log densities, from Mahalanobis distances with Cholesky factors
that are computed once. A logistic link, fitted on the evidence of the training rows, turns it into a
probability.

Training reads every labelled row outside the held-out fold; there is no sample. Class moments are sums
that Spark adds up, so the driver gets two classes' sums whatever the number of rows; the link is fitted
on a histogram of the evidence with a fixed number of bins.

Labels, language, source and id are never part of a score. The fold depends on the id alone.

Defined results
* null text: empty. Empty texts have a score like others.
* null id: crc32 of the empty text; its rows never train.
* A text with several labels trains with each; a null label trains nothing. Repeated rows train as often
  as they occur. A class without training rows makes all scores the share of the other class, and
  no training rows at all make them 0.5.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wareflow.llm.rows import map_texts, pieces, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import NOT_SPACE, chunks, hashed_windows, lookup, word_spans

UPPER, LOWER = lookup(range(0x41, 0x5B)), lookup(range(0x61, 0x7B))
DIGIT, HIGH = lookup(range(0x30, 0x3A)), lookup(range(0x80, 0x100))
STOP, COMMA = lookup(b".?!"), lookup(b",;:")
ODD = lookup(b"#$%&*+/<=>@[\\]^_`{|}~")
BLANK = lookup(b for b in range(256) if not NOT_SPACE[b])
LINE = lookup(b"\n")
N_FEATURES = 18
BINS, RANGE = 4096, 64.0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The root of a share: its spread depends less on its size."""
    return np.sqrt(part / np.maximum(whole, 1))


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its commonest one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(h))))
    return np.bincount(d[first], minlength=n).astype(float), most


def features(texts: list[bytes]) -> np.ndarray:
    """The statistics of each text, a row of N_FEATURES."""
    out = [np.empty((0, N_FEATURES))]
    for begin, end in chunks(texts):
        own = texts[begin:end]
        n = len(own)
        data = np.frombuffer(b" ".join(own) + b" ", np.uint8)
        at = np.cumsum([0] + [len(t) + 1 for t in own[:-1]])
        size = np.array([len(t) for t in own], float)
        count = lambda table: np.add.reduceat(table[data], at, dtype=np.int64).astype(float)  # noqa: E731, B023
        upper, lower, digit, high, stop, comma, odd = map(count, (UPPER, LOWER, DIGIT, HIGH, STOP, COMMA, ODD))
        blank, lines = count(BLANK) - 1, count(LINE) + 1
        joined, starts, ends, hashes, first = word_spans(own, NOT_SPACE)
        doc = np.repeat(np.arange(n), np.diff(first))
        words = np.diff(first).astype(float)
        length = (ends - starts).astype(float)
        sums = np.bincount(doc, length, n)
        squares = np.bincount(doc, length**2, n)
        mean = sums / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))
        tail = np.frombuffer(joined, np.uint8)[ends - 1] if len(ends) else np.empty(0, np.uint8)
        marked = np.bincount(doc, (ODD | STOP)[tail], n)
        distinct, most = _repeated(hashes, doc, n)
        triples = hashed_windows(hashes, 3)
        whole = doc[: len(triples)] == doc[2 : 2 + len(triples)] if len(triples) else np.empty(0, bool)
        some = doc[: len(triples)][whole]
        n_triples = np.bincount(some, minlength=n).astype(float)
        distinct_triples, _ = _repeated(triples[whole], some, n)
        letters = upper + lower + high
        columns = (
            np.log1p(size),
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            _share(upper, letters),
            _share(digit, size),
            _share(odd, size),
            _share(stop, words),
            _share(comma, words),
            _share(high, letters),
            _share(blank, size),
            _share(marked, words),
            np.log1p(lines),
            np.log1p(words / lines),
            np.log((1 + distinct) / (1 + words)),
            _share(most, words),
            _share(n_triples - distinct_triples, n_triples),
            _share(letters, size),
        )
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out)


class Discriminant:
    """Class densities with shrunk covariances, and the link from evidence to probability."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float):
        self.counts = counts
        self.slope, self.offset = 1.0, 0.0
        self.constant = 0.5 if not counts.sum() else float(counts[1] / counts.sum()) if not counts.all() else None
        if self.constant is not None:
            return
        self.means = sums / counts[:, None]
        spread = [products[c] / counts[c] - np.outer(self.means[c], self.means[c]) for c in (0, 1)]
        pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / counts.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.factors, self.log_det = [], []
        for c in (0, 1):
            unit = spread[c] / np.outer(self.scale, self.scale)
            whole = pooled / np.outer(self.scale, self.scale)
            # More shrinkage where a class has few rows for its many parameters.
            weight = min(1.0, shrink + len(unit) / counts[c])
            mixed = (1 - weight) * unit + weight * (0.5 * whole + 0.5 * np.trace(unit) / len(unit) * np.eye(len(unit)))
            mixed += 1e-6 * np.eye(len(unit))
            factor = np.linalg.cholesky(mixed)
            self.factors.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        parts = []
        for c in (0, 1):
            z = ((x - self.means[c]) / self.scale) @ self.factors[c].T
            parts.append(-0.5 * (np.einsum("nd,nd->n", z, z) + self.log_det[c]))
        return parts[1] - parts[0]

    def fit_link(self, x: np.ndarray, weights: np.ndarray) -> None:
        """Logistic regression of the label on squashed evidence x, by damped Newton steps.

        weights: training rows of each class, (bins, 2). A ridge of one row keeps separable classes
        from an endless slope.
        """
        total = weights.sum(axis=1)

        def loss(at: np.ndarray) -> float:
            z = at[0] * x + at[1]
            return float((total * np.logaddexp(0, z) - weights[:, 1] * z).sum() + 0.5 * (at @ at))

        at = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -500, 500)))
            gap, curve = weights[:, 1] - total * p, total * p * (1 - p)
            slope = np.array([(gap * x).sum(), gap.sum()]) - at
            bend = np.array([[(curve * x * x).sum(), (curve * x).sum()], [(curve * x).sum(), curve.sum()]]) + np.eye(2)
            step, size, now = np.linalg.solve(bend, slope), 1.0, loss(at)
            while size > 1e-6 and loss(at + size * step) > now:
                size /= 2
            at = at + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        self.slope, self.offset = max(float(at[0]), 1e-3), float(at[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.evidence(x)) + self.offset, -500, 500)))


def squash(evidence: np.ndarray) -> np.ndarray:
    """Evidence with its tails drawn in: a far outlier counts little more than a clear case."""
    return np.arcsinh(evidence)


def held_out(key: Column) -> Column:
    """The fold that never trains: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the features of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "features": list(features(texts_of(part.column(text))))}

    return map_texts(docs.select("doc_id", text), text, measure, f"doc_id {kind}, features array<double>")


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The rows of docs with all their columns and one of features, and that column's name, which no other has."""
    name = "features"
    while name in docs.columns:
        name += "_"
    kind = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    arrow = to_arrow_schema(kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                found = pa.array(list(features(texts_of(part.column(text)))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, arrow)), found.cast(arrow[-1].type)], schema=arrow)

    return docs.mapInArrow(measure, kind), name


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def moments(training: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of the features of both classes."""
    size = 1 + N_FEATURES + N_FEATURES**2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            x, y = _matrix(batch.column("features")), batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * size)), pa.array(total.ravel())], names=["at", "value"])

    sums = training.mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * size)
    for row in sums.collect():
        total[row["at"]] = row["value"]
    total = total.reshape(2, size)
    return total[:, 0], total[:, 1 : 1 + N_FEATURES], total[:, 1 + N_FEATURES :].reshape(2, N_FEATURES, N_FEATURES)


def fit(measured: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", shrink: float = 0.05) -> Discriminant:
    """A discriminant of the labelled rows outside the held-out fold. measured: from statistics()."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    training = scratch.keep(measured.join(known, "doc_id").select("features", "label"), "training")
    model = Discriminant(*moments(training), shrink)
    if model.constant is None:
        sent = training.sparkSession.sparkContext.broadcast(model)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = squash(sent.value.evidence(_matrix(batch.column("features"))))
                at = np.clip((x + RANGE) * (BINS / (2 * RANGE)), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["bin", "label"])

        weights = np.zeros((BINS, 2))
        for row in training.mapInArrow(place, "bin long, label int").groupBy("bin", "label").count().collect():
            weights[row["bin"], row["label"]] = row["count"]
        some = weights.sum(axis=1) > 0
        centres = (np.arange(BINS) + 0.5) * (2 * RANGE / BINS) - RANGE
        model.fit_link(centres[some], weights[some])
    scratch.drop(training)
    return model


def scored(measured: DataFrame, model: Discriminant, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every measured row."""
    kind = measured.schema["doc_id"].dataType.simpleString()
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(_matrix(batch.column("features")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = measured.mapInArrow(score, f"doc_id {kind}, score double")
    predicted = (F.col("score") >= least).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    measured = scratch.keep(statistics(docs, text), "statistics")
    return scored(measured, fit(measured, labels, scratch), least)


def accepted(measured: DataFrame, model: Discriminant, name: str, least: float = 0.3) -> DataFrame:
    """The rows of a table from with_features, without its column `name` of features, that score `least` or more."""
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(_matrix(batch.column(name)))
            yield batch.drop_columns([name]).filter(pa.array(scores >= least))

    return measured.mapInArrow(keep, StructType([f for f in measured.schema.fields if f.name != name]))
