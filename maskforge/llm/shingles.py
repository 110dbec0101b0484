"""Hashes of words and word shingles, over whole texts and without a Python step per word."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MOD = 1 << 64
#: Bytes that are hashed at once; the tables of powers have this length.
PIECE = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, _MOD)):
            out = np.ones(PIECE + 1, dtype=_U)
            done = 1
            while done <= PIECE:
                more = min(done, PIECE + 1 - done)
                with np.errstate(over="ignore"):
                    out[done : done + more] = out[:more] * _U(pow(base, done, _MOD))
                done += more
            _tables.append(out)
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U(_BASE)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _hash_piece(buffer: np.ndarray) -> np.ndarray:
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=_U)
    up, down = powers()
    with np.errstate(over="ignore"):
        total = np.empty(len(buffer) + 1, dtype=_U)
        total[0] = 0
        np.cumsum((buffer.astype(_U) + _U(1)) * up[: len(buffer)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def _hash_long_word(word: np.ndarray) -> np.ndarray:
    up, _ = powers()
    total, at = 0, 0
    with np.errstate(over="ignore"):
        while at < len(word):
            part = word[at : at + PIECE].astype(_U) + _U(1)
            total = (total + int(np.add.reduce(part * up[: len(part)])) * pow(_BASE, at, _MOD)) % _MOD
            at += PIECE
        return mix(np.array([(total + len(word)) % _MOD], dtype=_U))


def word_hashes(text: str | None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``; ``fold`` lower-cases A-Z first."""
    data = (text or "").encode("utf-8", "surrogatepass")
    data = data.translate(_LOWER) if fold else data
    buffer = np.frombuffer(data, dtype=np.uint8)
    if len(buffer) <= PIECE:
        return _hash_piece(buffer)
    out, at = [], 0
    while at < len(buffer):
        end = min(at + PIECE, len(buffer))
        if end < len(buffer):
            cut = np.flatnonzero(_SPACE[buffer[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word fills the piece
                more = end
                while more < len(buffer) and not len(cut := np.flatnonzero(_SPACE[buffer[more : more + PIECE]])):
                    more += PIECE
                end = min(more, len(buffer)) + (int(cut[0]) if more < len(buffer) else 0)
                out.append(_hash_long_word(buffer[at:end]))
                at = end
                continue
        out.append(_hash_piece(buffer[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words make one shingle, none an empty set."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        made = np.full(n, min(k, len(words)), dtype=_U)
        for j in range(min(k, len(words))):
            made = mix(made * _U(0xD6E8FEB86659FD93) + words[j : j + n])
    return np.unique(made)


def digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


class Signer:
    """Signature coordinates: each is made of the minima of ``rows`` random hash functions."""

    def __init__(self, coordinates: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = coordinates * rows
        self.coordinates, self.rows = coordinates, rows
        self.a = rng.integers(0, _MOD, n, dtype=_U, endpoint=False) | _U(1)
        self.b = rng.integers(0, _MOD, n, dtype=_U, endpoint=False)
        self.own = mix(np.arange(coordinates, dtype=_U))

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), _MOD - 1, dtype=_U)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 2048):
                block = hashes[i : i + 2048]
                np.minimum(least, (self.a[:, None] * block + self.b[:, None]).min(1), out=least)
            out = self.own.copy()
            for row in least.reshape(self.coordinates, self.rows).T:
                out = mix(out * _U(0xD6E8FEB86659FD93) + row)
        return out.view(np.int64)
