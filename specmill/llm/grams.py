"""Hashed word grams of texts, in arrays: helpers of the linear models."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Table(dict):
    """Token to number, filled on use; ``hashes`` has the columns that ``of`` gives for a token. Bounded: it starts anew when full."""

    def __init__(self, of, columns: int, most: int = 150_000):
        self.of, self.most = of, most
        self.hashes = np.zeros((most, columns), dtype=np.uint64)

    def __missing__(self, token: str) -> int:
        n = len(self)
        self.hashes[n] = self.of(token)
        self[token] = n
        return n

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) + len(tokens) > self.most:
            self.clear()
            if len(tokens) > self.most:  # one text with more tokens than the table has places
                return np.concatenate([self.rows(tokens[i:i + self.most]) for i in range(0, len(tokens), self.most)])
        return self.hashes[np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))]


def hash64(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def pair(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of ordered pairs; ``kind`` tells grams of different sorts apart."""
    h = (a * _A) ^ ((b + np.uint64(kind)) * _B)
    h ^= h >> np.uint64(29)
    return h * _C


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)
