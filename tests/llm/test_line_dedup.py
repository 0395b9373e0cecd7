"""Line deduplication against plain Python and SQL."""

import re
from collections import Counter

import pytest

from tests.llm.conftest import lowered, rows_of
from wareflow.llm import line_dedup
from wareflow.llm.line_dedup import ORDERED, LineRuns, _ordered_scans, dedup_lines, line_counts

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def expected(rows, threshold, least=1):
    keyed = [[(line, lowered(line.strip(BLANKS))) for line in (text or "").split("\n")] for _, text in rows]
    counts = Counter(key for lines in keyed for key in {k for _, k in lines if len(k) >= least})
    common = {k for k, n in counts.items() if n >= threshold}
    out = []
    for (doc_id, _), lines in zip(rows, keyed):
        kept = [line for line, key in lines if key not in common]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, "Shared line\nown one"), (2, " shared LINE \nown two"), (3, "SHARED line\t\n\n"), (4, None), (5, ""),
    (6, "é shared\nÉ shared"), (7, "é shared"), (8, "twice\ntwice"), (None, "shared line"), (9, "twice"),
    (1, "Shared line\nown one"), (10, "x" * 300_000 + "\nshared line"), (11, " shared line"), (12, "\r\n\r\n a"),
]


@pytest.mark.parametrize("most_sent", [1_000_000, 1])
@pytest.mark.parametrize("least", [1, 6, 0])
def test_small_cases(documents, scratch, most_sent, least):
    got = dedup_lines(documents(ROWS), scratch, threshold=3, least=least, batches=3, most_sent=most_sent)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == expected(ROWS, 3, least)


def test_one_hot_line_and_many_batches(documents, scratch):
    rows = [(k, f"hot\nline {k % 40}\nown {k}") for k in range(400)]
    got = dedup_lines(documents(rows, 8), scratch, threshold=11, batches=8)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == expected(rows, 11)


def test_empty_table(documents, scratch):
    assert dedup_lines(documents([]), scratch, threshold=3).count() == 0


def operators_of(df):
    return re.findall(r"(?:\+- |:- )\*?(?:\(\d+\) )?(\w+)", "+- " + df._jdf.queryExecution().executedPlan().toString())


def test_later_batches_do_not_count_what_is_common_already(spark, documents):
    runs = LineRuns(spark, 3, 5)
    for part in (ROWS[:3], ROWS[8:], ROWS[:3]):
        runs.add(runs.store(line_counts(documents(part), "text", 1, 1, 5)).select("h1", "h2", "n"))
    assert runs.common is not None and runs.common.count() == 1
    assert runs.levels[0][0].join(runs.common, ["h1", "h2"]).count() == 0
    assert runs.common_lines().distinct().count() == 2  # the shared line, and "own one" of three rows
    runs.drop(*[t[0] for t in runs.tables])
    assert not runs.tables and not [t for t in spark.catalog.listTables() if t.name.startswith("wareflow_run")]


def test_runs_are_merged_in_their_order(spark, documents):
    """Neither a shuffle nor a sort stands above the scan of a run."""
    runs = LineRuns(spark, 3, 4)
    made = [line_counts(documents([(k, f"hot\nline {k % 9}\nown {k}") for k in range(start, start + 60)]), "text", 1, 1, 4) for start in (0, 30, 60)]
    a, b, c = (runs.store(m).select("h1", "h2", "n") for m in made)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs.add(a)
        runs.add(b)
        with _ordered_scans(spark):
            for df in (runs.merged(a, c), runs.fresh(c), runs.merged(runs.common, c)):
                found = operators_of(df)
                assert "SortMergeJoin" in found and not {"Exchange", "Sort"} & set(found), found
        assert spark.conf.get(ORDERED) == "false"
        files = [f for f in runs.common.inputFiles()]
        assert len(files) <= 4 and len({f.rsplit("_", 1)[1] for f in files}) == len(files)  # one file a bucket
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_follow_the_size_of_the_input(documents, scratch, monkeypatch):
    added = []
    add = LineRuns.add
    monkeypatch.setattr(LineRuns, "add", lambda self, counts: added.append(1) or add(self, counts))
    monkeypatch.setattr(line_dedup, "BATCH_BYTES", 400)
    docs = scratch.keep(documents([(k, f"hot line\nown {k} " + "abc " * 50) for k in range(40)]), "docs")
    got = dedup_lines(docs, scratch, threshold=10)
    assert {r.n_dropped for r in got.collect()} == {1} and 1 < len(added) <= line_dedup.MOST_BATCHES
