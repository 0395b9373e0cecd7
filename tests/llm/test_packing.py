"""Packing: ids by the tokenizer, every id once, little padding."""

import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wareflow.llm.packing import WordEncoder, best_fit, pack, sequences
from wareflow.llm.queries import VOCABULARY

TEXTS = [
    "Hello, it's  a test\nof words.", "", None, "ΑΣ ΑΣΟΣ Ὀδυσσεύς", "a<|endoftext|>b THE<|startoftext|> <| |>", "x¼²½ µªº ÀÉßÿ a\xadb a\xa0b a\x85b",
    "É́ Å Å ﬁ ẞ ŉ ́a", " 's don'tx 'reve I'LL", "日本語 テスト 123 45\tq\r\n", "ǅ İi a\x1cb", "word " * 3000, "q" * 20_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_the_text(tokenizer):
    encoder = WordEncoder(VOCABULARY)
    for _ in range(2):  # the second time from memory
        got = encoder.encode([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(tokenizer, t)[:-1] for t in TEXTS]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that keeps case and lets blanks into tokens, and one with another token of its own."""
    texts = ["Hello  World", "it's \n\n two  Blanks ", "", "é É ﬁ", "mask [MASK] it"]
    other = public_tokenizers.path("byte_bpe_50k.json")
    changed = json.loads(Path(VOCABULARY).read_text())
    changed["added_tokens"].append(changed["added_tokens"][0] | {"id": 49408, "content": "[MASK]"})
    (tmp_path / "masked.json").write_text(json.dumps(changed))
    for path, by_words in ((other, False), (str(tmp_path / "masked.json"), False), (VOCABULARY, True)):
        made, whole = WordEncoder(path), Tokenizer.from_file(path)
        assert made.by_words == by_words
        for text, ids in zip(texts, made.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    for window in (1, 7, 64, 4096):
        for _ in range(20):
            lengths = sorted((rng.randint(1, window) for _ in range(200)), reverse=True)
            numbers, offsets = best_fit(lengths, window)
            room, used = [], defaultdict(int)
            for n, number, offset in zip(lengths, numbers, offsets):
                assert offset == used[number]
                used[number] += n
                fits = sorted(r for r in room if r >= n)
                if fits:
                    assert window - offset == fits[0]
                    room.remove(fits[0])
                    room.append(fits[0] - n)
                else:
                    assert offset == 0
                    room.append(window - n)
            assert max(used.values()) <= window


@pytest.mark.parametrize("group", [4096, 4])
def test_every_id_is_in_one_piece(documents, scratch, tokenizer, group):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "same"), (None, "same"), (0, "same")]
    packed = pack(documents(rows), scratch, VOCABULARY, window=128, with_ids=True, group=group).collect()
    got, places = defaultdict(list), defaultdict(list)
    for r in packed:
        raw = np.array(r.ids, "<u4")
        assert len(raw) == r.length and zlib.crc32(raw.tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        if r.doc_id:
            got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for doc_id, pieces in got.items():
        ids = [i for _, own, _ in sorted(pieces) for i in own]
        assert ids == ids_of(tokenizer, TEXTS[doc_id])
        assert all(start % 128 == 0 and total == len(ids) for start, _, total in pieces)
    assert sum(r.doc_id is None for r in packed) == 2
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]]
        assert sum(n for _, n in own) <= 128


def test_padding_is_small(documents, scratch):
    rng = random.Random(1)
    rows = [(k, "a " * rng.randint(1, 300)) for k in range(3000)]
    packed = pack(documents(rows), scratch, VOCABULARY, window=256, group=500).toPandas()
    used = packed.length.sum() / (256 * packed.sequence_id.nunique())
    assert used > 0.97


def test_sequences_are_padded(documents, scratch):
    packed = pack(documents([(1, "a b c"), (2, "d e")]), scratch, VOCABULARY, window=16, with_ids=True)
    (row,) = sequences(packed, 16).collect()
    assert len(row.ids) == len(row.documents) == 16
    assert row.documents == [1] * 4 + [2] * 3 + [0] * 9 and row.ids[3] == row.ids[6] == 2


def test_empty_table(documents, scratch):
    assert pack(documents([]), scratch, VOCABULARY).count() == 0
