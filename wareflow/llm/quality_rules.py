"""Rules on a text's words and lines, and a calibrated linear model of its word and character n-grams.

Method. Base rules count words, symbols, repeated lines and repeated word triples; a text that fails them goes.
The others are judged by a logistic regression on hashed word unigrams and bigrams and hashed character
n-grams (of bytes). A text is the mean weight of its n-grams of each kind, so its length doesn't count. The
model's evidence becomes a probability by Platt's link, fitted on a fifth of the training rows that the weights
don't see, and the probability is held against a fixed threshold.

Training reads the rows of a bounded sample of labelled ids: about `most_ids` of them, the ones with the least hash
of the id, and at most about `most_rows` of their rows, by a hash of id and text, however many rows an id has. Parts of the
sample are trained in tasks of their own (one part each `part_rows` rows) and their weights averaged, which is what the driver gets.
Rows that are equal in id and text train once. Labels never enter a score; language, source and id neither.

Defined results
* null, empty or blank text: no words; fails the rules. All counts are 0.
* Words and lines are compared by exact bytes, word triples by 64-bit hashes. Case counts.
* Words of texts of any length are counted whole; a text is read in the task that holds its row.
* null id: its rows never train. Repeated rows: each is reported. An id with both labels trains with each.
* No labelled rows of one class: every text that passes the rules has the probability of the only class, or 0.5.
* Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.llm.rows import map_texts, text_key, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import NOT_SPACE, U, chunks, hashed_windows, lookup, mix, word_spans

#: Characters that count as symbols; bytes that begin a code point; blanks.
SYMBOLS = lookup(b"#*$%&|<>")
LEADING = lookup(b for b in range(256) if b & 0xC0 != 0x80)
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Weights of each kind of n-gram, and the kinds: words, pairs of words, runs of 3 and of 5 bytes.
SLOTS, KINDS = 1 << 14, 4
BYTES = (3, 5)
#: A kind's values are its shares times this, so that weights and the ridge have a common scale.
SCALE = 8.0
#: Bytes or words whose n-grams are held at once.
SPAN = 1 << 18
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in triples which the text has more than once."""
    out = np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    triples = hashed_windows(hashes, 3)
    at = np.flatnonzero(doc[: len(triples)] == doc[2 : 2 + len(triples)]) if len(triples) else np.empty(0, np.int64)
    if not len(at):
        return out
    order = at[np.lexsort((triples[at], doc[at]))]
    same = (triples[order][1:] == triples[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[twice + k] = True
    np.add.at(out, doc[covered], 1)
    return out


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _ngrams(data: np.ndarray, begin_of: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, text of each n-gram, slot of each n-gram), in blocks of SPAN bytes or words.

    data: the texts with a blank after each, beginning at begin_of; doc: the text of each word.
    """
    for at in range(0, len(hashes), SPAN):
        own = doc[at : at + SPAN]
        yield 0, own, (hashes[at : at + SPAN] & U(SLOTS - 1)).astype(np.int64)
        own = doc[at : at + SPAN + 1]
        inside = own[:-1] == own[1:]
        pairs = hashed_windows(hashes[at : at + SPAN + 1], 2)[inside] if len(own) > 1 else np.empty(0, U)
        yield 1, own[:-1][inside], (pairs & U(SLOTS - 1)).astype(np.int64)
    for at in range(0, len(data), SPAN):
        last = min(at + SPAN, len(data))
        of = np.repeat(np.arange(len(begin_of) - 1, dtype=np.int32), np.diff(np.clip(begin_of, at, last + max(BYTES))))
        for kind, n in enumerate(BYTES, 2):
            size = max(min(last, len(data) - n + 1) - at, 0)
            run = np.zeros(size, U)
            for k in range(n):
                run = (run << U(8)) | data[at + k : at + k + size]
            inside = of[:size] == of[n - 1 : n - 1 + size]
            yield kind, of[:size][inside], (mix(run[inside] + U(n)) & U(SLOTS - 1)).astype(np.int64)


def measured(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, Iterator]]:
    """Ranges of texts: their number, their COUNTS as columns, and their n-grams, which can be read once."""
    for begin, end in chunks(texts):
        own = texts[begin:end]
        n = len(own)
        joined, starts, ends, hashes, first = word_spans(own, NOT_SPACE, fold=False)
        data = np.frombuffer(joined, np.uint8)
        at = np.cumsum([0] + [len(t) + 1 for t in own])
        doc = np.repeat(np.arange(n), np.diff(first))
        count = lambda table: np.add.reduceat(table[data], at[:-1], dtype=np.int64)  # noqa: E731, B023
        counts = np.stack(
            (
                np.diff(first),
                count(LEADING & NOT_SPACE),
                count(SYMBOLS),
                [_repeated_lines(t) for t in own],
                _repeated_words(hashes, first),
            ),
            axis=1,
        )
        yield n, counts, _ngrams(data, at, hashes, doc)


def evidence(weights: np.ndarray, ngrams: Iterator, n: int) -> np.ndarray:
    """The model's linear score of each text. weights: KINDS rows of SLOTS, then the constant."""
    total, times = np.zeros((KINDS, n)), np.zeros((KINDS, n))
    for kind, doc, slot in ngrams:
        total[kind] += np.bincount(doc, weights[kind * SLOTS + slot], n)
        times[kind] += np.bincount(doc, minlength=n)
    return weights[-1] + SCALE * (total / np.maximum(times, 1)).sum(axis=0)


def shares(ngrams: Iterator, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text's slots over all kinds, and SCALE times the slot's share of the text's n-grams of that kind."""
    size = KINDS * SLOTS
    found = [np.unique(doc.astype(np.int64) * size + kind * SLOTS + slot, return_counts=True) for kind, doc, slot in ngrams]
    place, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    times = np.bincount(at, np.concatenate([f[1] for f in found]), len(place))
    of_kind = place // SLOTS  # text and kind
    value = SCALE * times / np.bincount(of_kind, times, n * KINDS)[of_kind]
    edges = np.searchsorted(place, np.arange(n + 1) * size)
    ranges = list(zip(edges, edges[1:]))
    return [place[a:b] % size for a, b in ranges], [value[a:b] for a, b in ranges]


def regression(slot: np.ndarray, value: np.ndarray, row: np.ndarray, label: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression on sparse rows, by conjugate gradients inside Newton steps.

    Both classes weigh the same in the sum, so that a rare class is learned too; the link undoes it.
    """
    n, size = len(label), KINDS * SLOTS + 1
    slot = np.concatenate((slot, np.full(n, size - 1)))
    value = np.concatenate((value, np.ones(n)))
    row = np.concatenate((row, np.arange(n)))
    share = np.array([(label == c).mean() for c in (0, 1)])
    each = 0.5 / np.maximum(share, 1 / n)[label] / n
    forward = lambda w: np.bincount(row, w[slot] * value, n)
    back = lambda r: np.bincount(slot, r[row] * value, size)
    w, left = np.zeros(size), steps
    while left > 0:
        z = forward(w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = back(each * (p - label)) + ridge * w
        if np.abs(gradient).max() < 1e-7:
            break
        curve = np.maximum(each * p * (1 - p), 1e-12)
        d, r = np.zeros(size), -gradient
        q, rr = r.copy(), r @ r
        for _ in range(12):
            bent = back(curve * forward(q)) + ridge * q
            step = rr / (q @ bent)
            d += step * q
            r -= step * bent
            left -= 1
            new = r @ r
            if new < 1e-4 * (gradient @ gradient):
                break
            q, rr = r + (new / rr) * q, new
        towards = forward(d)
        loss = lambda s: float((each * (np.logaddexp(0, z + s * towards) - label * (z + s * towards))).sum() + 0.5 * ridge * ((w + s * d) @ (w + s * d)))  # noqa: E731, B023
        s, now = 1.0, loss(0.0)
        while s > 1e-4 and loss(s) > now:
            s /= 2
        w = w + s * d
        left -= 1
    return w


def platt(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 as a logistic function of x, with Platt's smoothed targets."""
    ones, zeros = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    centre, spread = x.mean(), max(x.std(), 1e-9)
    z, at = (x - centre) / spread, np.array([1.0, 0.0])
    loss = lambda a: float((np.logaddexp(0, a[0] * z + a[1]) - goal * (a[0] * z + a[1])).sum() + 0.01 * (a @ a))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -500, 500)))
        slope = np.array([((goal - p) * z).sum(), (goal - p).sum()]) - 0.02 * at
        curve = p * (1 - p)
        bend = np.array([[(curve * z * z).sum(), (curve * z).sum()], [(curve * z).sum(), curve.sum()]]) + 0.02 * np.eye(2)
        step, s = np.linalg.solve(bend, slope), 1.0
        while s > 1e-6 and loss(at + s * step) > loss(at):
            s /= 2
        at = at + s * step
        if np.abs(s * step).max() < 1e-9:
            break
    return float(at[0] / spread), float(at[1] - at[0] * centre / spread)


class Model:
    """Weights and link; or one probability for all, where a class has no training rows."""

    def __init__(self, weights: np.ndarray | None, slope: float = 1.0, offset: float = 0.0, constant: float | None = None):
        self.weights, self.slope, self.offset, self.constant = weights, slope, offset, constant

    def probabilities(self, ngrams: Iterator, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence(self.weights, ngrams, n) + self.offset, -500, 500)))


def _least(key, fraction: float):
    """Whether a 64-bit hash lies in the lowest `fraction` of its range."""
    if fraction >= 1:
        return F.lit(True)
    return key < F.lit(int(-(1 << 63) + fraction * (1 << 64)))


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str, label: str, most_ids: int, most_rows: int) -> DataFrame:
    """(label, fold, slots, values) of the sample: fold 0 is for the link, the rest for the weights."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col(label) == 0).cast("int")).alias("zero"), F.max((F.col(label) == 1).cast("int")).alias("one")
    )
    ids = known.count()
    known = scratch.keep(known.where(_least(F.xxhash64("doc_id"), most_ids / max(ids, 1))), "labelled")
    # The expected number of ids is most_ids, whatever the input; beyond twice that they are joined.
    small = F.broadcast(known) if known.count() <= 2 * most_ids else known
    rows = docs.select("doc_id").join(small, "doc_id").count()
    key = F.xxhash64(F.lit("row"), F.col("doc_id"), text_key(F.col(text)))
    picked = docs.select("doc_id", F.col(text).alias("text")).where(_least(key, most_rows / max(rows, 1))).join(small, "doc_id")
    picked = picked.groupBy("doc_id", "text").agg(F.max("zero").alias("zero"), F.max("one").alias("one"))
    picked = picked.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)))

    def sparse(part: pa.RecordBatch) -> dict:
        slots, values = [], []
        for n, _, ngrams in measured(texts_of(part.column("text"))):
            a, b = shares(ngrams, n)
            slots += a
            values += b
        return {"zero": part.column("zero"), "one": part.column("one"), "fold": part.column("fold"), "slots": slots, "values": values}

    found = map_texts(picked, "text", sparse, "zero int, one int, fold long, slots array<int>, `values` array<float>")
    found = found.withColumn("label", F.explode(F.expr("filter(array(IF(zero = 1, 0, -1), IF(one = 1, 1, -1)), x -> x >= 0)")))
    return scratch.keep(found.select("label", "fold", "slots", "values"), "training")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", label: str = "quality", most_ids: int = 12_000, most_rows: int = 16_000, part_rows: int = 1_000) -> Model:
    """A model of the labelled rows of docs; most_ids and most_rows bound the sample that trains."""
    training = training_rows(docs, labels, scratch, text, label, most_ids, most_rows)
    sizes = {(bool(r["link"]), r["label"]): r["n"] for r in training.groupBy((F.col("fold") == 0).alias("link"), "label").agg(F.count("*").alias("n")).collect()}
    for_weights, for_link = [sizes.get((False, c), 0) for c in (0, 1)], [sizes.get((True, c), 0) for c in (0, 1)]
    if not min(for_weights):
        total = [a + b for a, b in zip(for_weights, for_link)]
        return Model(None, constant=0.5 if not sum(total) else total[1] / sum(total))
    parts = max(1, round(sum(for_weights) / part_rows))
    size = KINDS * SLOTS + 1

    def train(part: pd.DataFrame) -> pd.DataFrame:
        slots = part["slots"].tolist()
        row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        w = regression(np.concatenate(slots).astype(np.int64), np.concatenate(part["values"].tolist()).astype(float), row, part["label"].to_numpy(np.int64))
        return pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "n": [len(slots)]})

    dealt = training.where("fold <> 0").withColumn("part", F.pmod(F.xxhash64("slots"), F.lit(parts)))
    weights, n = np.zeros(size), 0
    for r in dealt.groupBy("part").applyInPandas(train, "weights binary, n long").toLocalIterator():  # a part at a time
        weights += np.frombuffer(r["weights"], "<f8") * r["n"]
        n += r["n"]
    weights /= n
    sent = training.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = batch.column("slots"), batch.column("values")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(slots).to_numpy())
            x = np.bincount(row, sent.value[slots.flatten().to_numpy()] * values.flatten().to_numpy(), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x + sent.value[-1]), batch.column("label")], names=["x", "label"])

    # Where the link's fold lacks a class, all rows set it.
    chosen = training.where("fold = 0") if min(for_link) else training
    seen = chosen.mapInArrow(judge, "x double, label int").toPandas()  # two numbers for each row of the sample
    scratch.drop(training)
    return Model(weights, *platt(seen["x"].to_numpy(), seen["label"].to_numpy(np.int64)))


def judge(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, the COUNTS, base_failed, probability and kept of every row.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in repeated triples. kept: not
    so, and the model gives `least` or more.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def look(part: pa.RecordBatch) -> dict:
        counts, chances = [np.empty((0, len(COUNTS)), np.int64)], [np.empty(0)]
        for n, own, ngrams in measured(texts_of(part.column(text))):
            counts.append(own)
            chances.append(sent.value.probabilities(ngrams, n))
        counts, chances = np.concatenate(counts), np.concatenate(chances)
        found = dict(zip(COUNTS, counts.T))
        failed = (found["n_words"] < least_words) | (100 * found["n_repeat_words"] > most_repeated * found["n_words"])
        return {"doc_id": part.column("doc_id"), **found, "base_failed": failed, "probability": chances, "kept": ~failed & (chances >= least)}

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, probability double, kept boolean"
    return map_texts(docs.select("doc_id", text), text, look, schema)
