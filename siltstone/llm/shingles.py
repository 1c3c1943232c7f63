"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in slices of about so many bytes; a longer text is cut between words.
SLICE_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # 5 modulo 8: powers of it repeat as late as possible
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint64)
    value = mix(lower * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) | np.uint64(1)
    value[space] = 0
    return space, value


_SPACE, _VALUE = _tables()
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of some bytes: a polynomial of its lower-cased bytes, mixed with its length."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * up)])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_PLACES[7]))


def _long_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slice by slice, cut at white space."""
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        while end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(raw), end + 4096)
        found.append(_words(raw[at:end])[1])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of one text's words; fewer words than `width` are one shingle."""
    if not len(words):
        return words
    if len(words) < width:
        return mix((words * _PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACES[k]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], width: int = 4) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words, at most 7. Words are runs
    without white space (blank, \\t to \\r), A-Z lower-cased. Null and blank texts have the empty set."""
    for words in text_words(texts):
        yield _shingles(words, width)


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words in order, by the same rules as shingle_sets."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out, at = [], 0
    while at < len(raw):
        if len(raw[at]) > SLICE_BYTES:
            out.append(_long_words(np.frombuffer(raw[at], np.uint8)))
            at += 1
            continue
        end, size = at, 0
        while end < len(raw) and len(raw[end]) <= SLICE_BYTES and (end == at or size + len(raw[end]) <= SLICE_BYTES):
            size += len(raw[end]) + 1
            end += 1
        starts, words = _words(np.frombuffer(b" ".join(raw[at:end]), np.uint8))
        out += np.split(words, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw[at:end]]))[:-1])
        at = end
    return out
