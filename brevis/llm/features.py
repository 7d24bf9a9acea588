"""Hashed n-gram counts with numpy, and their sums over a table."""

from __future__ import annotations

import re

import numpy as np

BITS = 14
DIMS = 1 << BITS
_OTHER = re.compile(r"[\W\d_]+")


def _fold(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def gram_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of the 1-, 2- and 3-grams of uint32 codes in DIMS hashed buckets."""
    if not codes.size:
        return np.zeros(DIMS, np.int64)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] + np.uint32(0x7F4A7C15)
    three = two[:-1] * np.uint32(0x85EBCA6B) + codes[2:] + np.uint32(0x165667B1)
    return np.bincount(np.concatenate([_fold(codes + np.uint32(77)), _fold(two), _fold(three)]), minlength=DIMS)


def letter_counts(text: str) -> np.ndarray:
    """Of lower-cased letters, everything else taken as one space."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    return gram_counts(np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4"))


def byte_counts(data: bytes) -> np.ndarray:
    """Of the bytes as they are, ASCII letters lower-cased."""
    return gram_counts(np.frombuffer(data.lower(), np.uint8).astype(np.uint32))
