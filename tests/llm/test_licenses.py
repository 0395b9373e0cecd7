"""Licence recognition: whole texts, order, gaps, and all documents against a plain search."""

import pytest

from tests.llm.conftest import rows_of
from wareflow.llm import licenses
from wareflow.llm.licenses import RULES, SENTENCES, SentenceRules, scan

APACHE = """/* Copyright 2020 Someone
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License. */"""
MIT = "\n\n".join(SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is"))
BSD2 = " ".join(SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
BSD3 = BSD2 + "\n" + SENTENCES["bsd-endorse"][0]


@pytest.fixture(scope="module")
def known():
    return SentenceRules(SENTENCES, RULES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("Nothing here.", []),
        (APACHE, ["Apache-2.0"]),
        (MIT, ["MIT"]),
        (BSD2, ["BSD-2-Clause"]),
        (BSD3, ["BSD-3-Clause"]),
        (BSD2 + "\n" + "One. " * 9 + SENTENCES["bsd-endorse"][0], ["BSD-2-Clause"]),  # too far away
        (SENTENCES["bsd-endorse"][0] + " " + BSD2, ["BSD-2-Clause"]),  # out of order
        (SENTENCES["bsd-source"][0], []),  # no rule is made of this alone
        ("so\nReleased under the MIT License.\nAll rights reserved.", ["MIT", "all-rights-reserved"]),
        ("RELEASED under the\n mit license", ["MIT"]),
        ("It is not Released under the MIT License.", []),  # another sentence
        ("Released under the MIT License or another.", []),
        ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", ["CC-BY-NC-4.0", "CC-BY-4.0"]),
        (MIT + "\nAll rights reserved.\n" + MIT, ["MIT", "all-rights-reserved", "MIT"]),
        ("x " * 200_000 + "\nAll rights reserved.", ["all-rights-reserved"]),
    ],
)
def test_texts(known, text, want):
    found = known.licences(text.encode(), 3)
    assert [m[0] for m in found] == want
    assert found == sorted(found, key=lambda m: m[1])
    for _, begin, end in found:
        assert 0 <= begin < end <= len(text.encode())


def test_every_rule_is_made_of_known_sentences_and_found(known):
    for licence, names in RULES:
        assert set(names) <= set(SENTENCES)
        text = "\n".join(SENTENCES[n][0] for n in names)
        assert licence in [m[0] for m in known.licences(text.encode(), 3)]


def test_rows(documents):
    rows = [(1, APACHE), (None, "All rights reserved."), (2, None), (2, ""), (1, APACHE), (3, "é " + MIT)]
    got = scan(documents(rows))
    assert rows_of(got, "doc_id", "licences") == sorted(
        [(1, ["Apache-2.0"]), (1, ["Apache-2.0"]), (None, ["all-rights-reserved"]), (2, []), (2, []), (3, [])], key=repr
    )
    assert scan(documents([])).count() == 0


def test_all_supplied_documents_against_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {v.rstrip("."): r for r, names in RULES if len(names) == 1 for v in SENTENCES[names[0]]}
    want = {r.doc_id: {lines[x] for line in r.text.split("\n") if (x := line.strip().rstrip("."))in lines} for r in docs.collect()}
    got = {r.doc_id: set(r.licences) for r in licenses.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 10
