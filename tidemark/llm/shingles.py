"""Sets of hashed word shingles of whole texts, in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return freed memory to the system; called when a task is done with its rows, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, one after another; where each text's words begin, and the end).

    Words are runs of bytes other than ASCII white space, A to Z in lower case if asked; a null text has none.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names.astype(object), categorize=False) if len(names) else np.empty(0, np.uint64)
    which = coded.indices.to_numpy()
    # A text that begins or ends in white space has an empty word there.
    real = (names != "")[which] if len(names) else np.empty(0, bool)
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return hashes[which[real]], np.concatenate([[0], np.cumsum(real)])[bounds].astype(np.int64)


def shingle_sets(texts: pa.Array, words: int, lower: bool = True, at_once: int = 2 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` words.

    A text of fewer words has the one shingle of all its words; a text without words, or null, has none.  Whole texts are
    read, some megabytes at a time.
    """
    texts = pc.fill_null(texts, "")
    step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for low, high in zip(cuts, cuts[1:], strict=False):
        w, bounds = word_hashes(texts.slice(low, high - low), lower)
        runs = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            runs = runs * _STEP + w[k : k + len(runs)]
        runs = mix(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for x in w[a:b]:
                    whole = (np.array([whole]) * _STEP + x)[0]
                yield mix(np.array([whole]))
            else:
                yield np.empty(0, np.uint64)
