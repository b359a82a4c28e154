"""Arrow batches of texts to arrays of word hashes and word shingles, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text, and shingles, that are worked on at a time.
PIECE = 1 << 20
RUN = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    each = pd.util.hash_array(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False)
    hashes = each[coded.indices.to_numpy()]
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        hashes, offsets = hashes[full], before[offsets]
    return hashes, offsets


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes that end at white space; a longer word is in one piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + most)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and where each text's words begin (one entry more than texts).

    A-Z are lower-cased, words are parted by ASCII white space; null is an empty text. A very long text goes piece by piece,
    so that beside the text itself only eight bytes a word are held.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) != 1 or pc.binary_length(texts)[0].as_py() <= 2 * PIECE:
        return _hashed(texts)
    parts = [_hashed(pa.array([p], pa.large_binary()).cast(pa.large_string()))[0] for p in pieces(texts.cast(pa.large_binary())[0].as_py())]
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, and where each text's begin. Fewer words: the whole sequence is one."""
    words, start = word_hashes(texts)
    n = np.diff(start)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    every = np.zeros(first[-1], np.uint64)
    for a in range(0, len(every), RUN):  # in runs, so that the temporary arrays stay small
        z = np.arange(a, min(a + RUN, len(every)))
        owner = np.searchsorted(first, z, side="right") - 1
        at = z - first[owner] + start[owner]
        left = start[owner + 1] - at  # words from here to the text's end
        h = np.zeros(len(z), np.uint64)
        for i in range(size):
            h += np.where(left > i, mixed(padded[at + i] + np.uint64(i + 1)), np.uint64(0)) * _MULTIPLIERS[i % 5]
        every[a : a + RUN] = mixed(h)
    if len(n) == 1:
        every = np.unique(every)
        return every, np.array([0, len(every)])
    owner = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((every, owner))
    h, owner = every[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = PIECE):
    """The batch in slices of about `most` bytes of text, so that a worker's arrays stay small; one very long text is one slice."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.take(pa.array(np.arange(a, b)))  # a copy: string kernels misread arrays that begin inside a buffer
