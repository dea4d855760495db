"""Vectorised hashes of the words and word n-grams of many texts.

A word or n-gram has a *hash* of 64 bits and a *check* of 32 more, with multipliers of its own,
so that two that share a hash by chance don't share the check as well.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _BASE_CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)
_BLOCK = 8  # bytes of a word that are taken at a time
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(_BLOCK + 1)], np.uint64)  # masks of the first n bytes
_LONG = 256  # words of more bytes are hashed one by one
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_check(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check and start of each word of bytes that end in a space."""
    buf = np.frombuffer(data + bytes(_BLOCK), np.uint8)  # a block may be read from each byte
    inside = ~_SPACE[buf[: len(data)]]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    blocks = np.ndarray(len(data), "<u8", buf, strides=(1,))
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) * _BASE)
    checks = mix(hashes)
    at, left, some = starts, np.where(lengths <= _LONG, lengths, 0), np.arange(len(starts))
    while True:
        more = np.flatnonzero(left > 0)
        if not len(more):
            break
        if len(more) < len(left):
            at, left, some = at[more], left[more], some[more]
        block = blocks[at] & _LOW[np.minimum(left, _BLOCK)]
        hashes[some] = mix((hashes[some] + block) * _BASE)
        checks[some] = mix((checks[some] ^ block) * np.uint64(0xD6E8FEB86659FD93))
        at, left = at + _BLOCK, left - _BLOCK
    for i in np.flatnonzero(lengths > _LONG):
        word = data[starts[i] : ends[i]]
        hashes[i], checks[i] = xxhash.xxh3_64_intdigest(word, 1), xxhash.xxh3_64_intdigest(word, 2)
    return hashes, (checks >> np.uint64(32)).astype(np.uint32), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and checks of all words in order, and offsets: the words of text i are from offsets[i] to offsets[i+1]."""
    hashes, checks, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < _PIECE):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        h, c, starts = _piece_hashes(b" ".join(part) + b" ")
        limits = np.cumsum([len(t) + 1 for t in part])
        counts.append(np.diff(np.searchsorted(starts, limits), prepend=0))
        hashes.append(h)
        checks.append(c)
        at = upto
    return np.concatenate(hashes), np.concatenate(checks), np.cumsum(np.concatenate(counts))


def n_words(texts: list[bytes]) -> int:
    """How many words the texts have."""
    inside = ~_SPACE[np.frombuffer(b" ".join([b"", *texts]), np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions in the last n-1 are left out."""
    out = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        out = mix(out * _BASE + words[k : len(words) - n + 1 + k] + np.uint64(k))
    return out


def gram_checks(checks: np.ndarray, n: int) -> np.ndarray:
    """The same for checks."""
    out = checks[: max(0, len(checks) - n + 1)]
    for k in range(1, n):
        out = mix_check(out * _BASE_CHECK + checks[k : len(checks) - n + 1 + k] + np.uint32(k))
    return out


def gram_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """True at each position whose n words lie in one text."""
    total = int(offsets[-1])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return left[: max(0, total - n + 1)] >= n
