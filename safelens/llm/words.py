"""Hashes of all words of many texts at once, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Bytes hashed together. Longer runs are cut between words.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
#: Letters, digits and everything beyond ASCII make words; A-Z are lower-cased.
#: Of the table that only parts words at white space, A-Z are lower-cased too, and everything else stays.
PLAIN = np.array([32 if c in b" \t\n\x0b\x0c\r" else ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)
TABLE = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, np.uint64(base)), dtype=np.uint64)])


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def folded(raw: bytes) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (in UTF-8) lower-cased, and spaces for what is in no word."""
    out = TABLE[np.frombuffer(raw, np.uint8)]
    if len(out) > 1:
        second = out[1:]
        second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def plain(raw: bytes) -> np.ndarray:
    """Bytes with A-Z lower-cased and spaces for all white space: words are then those of ``raw.lower().split()``."""
    return PLAIN[np.frombuffer(raw, np.uint8)]


def _piece(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = text != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if inside[0] else [], edges, [len(text)] if inside[-1] else []]).astype(np.int64)
    first, last = edges[::2], edges[1::2]
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POWER[: len(text)], out=total[1:])
    return first, (total[last] - total[first]) * _INVERSE[first]


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 64-bit hashes) of the words of folded bytes. A word's hash doesn't depend on its place."""
    starts, hashes = [], []
    at, run, held = 0, 0, np.empty(0, np.uint64)  # run: bytes so far of a word that is longer than a piece; held: ends with its value
    with np.errstate(over="ignore"):
        while at < len(text):
            end, inside = min(at + PIECE, len(text)), False
            if end < len(text):
                gaps = np.flatnonzero(text[at:end] == 32)
                inside = not len(gaps)
                end = end if inside else at + int(gaps[-1]) + 1
            first, value = _piece(text[at:end])
            if run and text[at] != 32:  # it goes on: the same polynomial, with higher powers
                held[-1] += value[0] * np.uint64(pow(_BASE, run, 1 << 64))
                first, value = first[1:], value[1:]
            if len(first):
                starts.append(first + at)
                hashes.append(value)
                held = value
            run = run + end - at if inside else 0
            at = end
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        value = np.concatenate(hashes)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.concatenate(starts), value ^ (value >> np.uint64(32))


def grouped(texts: Iterable[bytes | None], size: int = PIECE, fold: Callable[[bytes], np.ndarray] = folded) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in groups of about ``size`` bytes: (numbers, hashes of all their words, where each text's words begin and end)."""
    held: list[bytes] = []
    numbers: list[int] = []
    total = 0

    def flush():
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])])
        starts, hashes = word_hashes(fold(b" ".join(held)))
        return numbers, hashes, np.searchsorted(starts, offsets)

    for i, text in enumerate(texts):
        held.append(text or b"")
        numbers.append(i)
        total += len(held[-1]) + 1
        if total >= size:
            yield flush()
            held, numbers, total = [], [], 0
    if held:
        yield flush()
