"""Registered queries that SQL can't express, over their whole tables."""

import re

from tests.llm.test_quality_rules import expected as counted
from wareflow.llm.queries import QUERIES
from wareflow.llm.quality_rules import COUNTS

BASE = "/root/testdata/sf0.01"


def test_languages_of_all_pages(spark):
    """The addresses of most pages end in the number of the document it was made from."""
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    url = {r.page_id: r.url for r in spark.read.parquet(f"{BASE}/pages.parquet").collect()}
    made_of = {k: int(m[1]) for k, u in url.items() if (m := re.search(r"/(\d+)(?:[?#].*)?$", u or ""))}
    found = {r.page_id: r.lang for r in QUERIES["op3_language"](spark, BASE).collect()}
    assert found.keys() == url.keys()
    known = [k for k in made_of if made_of[k] in lang]
    assert len(known) > 150 and sum(found[k] == lang[made_of[k]] for k in known) >= 0.99 * len(known)


def test_rules_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    rows = QUERIES["op12_quality_rules"](spark, BASE).collect()
    assert sorted((r.doc_id, *(r[c] for c in COUNTS), r.base_failed) for r in rows) == sorted(counted(k, t) for k, t in docs.items())
    assert not any(r.kept and r.base_failed for r in rows)
    judged = [r for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(r.kept == (quality[r.doc_id] == 1) for r in judged) >= 0.97 * len(judged)
    rest = [r for r in rows if r.doc_id not in quality and not r.base_failed]
    assert 0.8 < sum(r.kept for r in rest) / len(rest) < 1
