"""Words and their hashes for whole batches of texts at once.

The helpers work on UTF-8 bytes: lower-casing A-Z and the word classes used here only look at
ASCII, so bytes and characters agree. A word's hash is a polynomial of its bytes modulo 2^64,
taken as a difference of prefix sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def lookup(words: Iterable[int]) -> np.ndarray:
    """A table over byte values: true for bytes of a word."""
    table = np.zeros(256, bool)
    table[list(words)] = True
    return table


#: Everything but the space and 0x09 to 0x0D.
NOT_SPACE = lookup(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Everything but the space and the line feed.
NOT_BLANK = lookup(b for b in range(256) if b not in b" \n")
#: Digits, a to z and everything outside ASCII.
LETTERS = lookup([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, grown by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.empty(size, U)
        table[0] = 1
        done = 1
        while done < size:
            table[done : 2 * done] = table[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        if size <= 1 << 19:  # what a range of `chunks` needs
            _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of `most` bytes with a blank after each; a longer text is a range of its own."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) + 1 > most:
            yield begin, k
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_spans(texts: list[bytes], table: np.ndarray, fold: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one, lower-cased if `fold`, each word's begin, end and hash, and each text's first word.

    The last array has one entry more than there are texts.
    """
    joined = b" ".join(t.lower() if fold else t for t in texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power_table(BASE, len(data))[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table(BASE_INVERSE, len(data))[starts]
    hashes = mix(hashes + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return joined, starts, ends, hashes, np.searchsorted(starts, first)


def hashed_words(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and where each text's words begin (one more at the end)."""
    return word_spans(texts, table)[3:]


def hashed_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.zeros(n, U)
    for k in range(width):
        out = out * U(0xD1342543DE82EF95) + mix(hashes[k : k + n] + U(k + 1))
    return mix(out)


def shingle_sets(texts: list[bytes], width: int, table: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for begin, end in chunks(texts):
        hashes, first = hashed_words(texts[begin:end], table)
        windows = hashed_windows(hashes, width)
        for k in range(end - begin):
            a, b = first[k], first[k + 1]
            if b - a >= width:
                found = np.sort(windows[a : b - width + 1])
                out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
            elif b > a:
                out.append(hashed_windows(hashes[a:b], b - a) + U(b - a))
            else:
                out.append(np.empty(0, U))
    return out
