"""Hashed word shingles of a text: their set, its SimHash, SimHashes of samples of it, and a
short mark of each shingle drawn, by which the similarity of two sets can be estimated."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from recordloom.llm.common import slices

SEED = 42
#: Samples of a text and shingles in each. Two texts that share 0.8 of their shingles have
#: an equal sample with probability 0.8 ** 5, and one at least of 20 with 0.9996.
TABLES = 20
SAMPLE = 5
#: Shingles that are looked at in one step.
STEP = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(str(k).encode(), seed) | 1 for k in range(n)], dtype=np.uint64)


def shingle_set(text: str | None, ngram: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ngram words, A-Z as small letters.

    A text with fewer words is one shingle; one without words has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    code = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), words), dtype=np.uint64, count=len(words))
    wide = min(ngram, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, dtype=np.uint64)
    for k in range(wide):
        out = (out ^ code[k : k + n]) * ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For (..., n) hashes, the (...) numbers of the bits that more than half have."""
    bits = np.unpackbits(hashes[..., None].view("u1"), axis=-1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=-2, dtype=np.int64) > hashes.shape[-1], axis=-1, bitorder="little").view("<u8")[..., 0]


def whole_print(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        part = np.ascontiguousarray(hashes[at : at + STEP])
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def inverses(times: np.ndarray) -> np.ndarray:
    return np.array([pow(int(x), -1, 2**64) for x in times], dtype=np.uint64)


def samples(hashes: np.ndarray, times: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each odd factor the hash whose product with it, modulo 2**64, is smallest; back
    are the factors' inverses."""
    least = np.full(len(times), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (times[:, None] * hashes[None, at : at + STEP]).min(axis=1), out=least)
    return least * back


def sample_prints(drawn: np.ndarray, tables: int) -> np.ndarray:
    """(texts, tables) SimHashes of the samples drawn, (texts, tables * SAMPLE)."""
    mixed = (drawn.reshape(len(drawn), tables, -1) ^ odd_numbers(tables, SEED + 1)[None, :, None]) * ODD
    return majority(mixed ^ (mixed >> np.uint64(31)))


def marks(drawn: np.ndarray) -> np.ndarray:
    """16 bits of each shingle drawn."""
    return ((drawn * ODD) >> np.uint64(48)).astype("<u2")


def signatures(batches: Iterator[pa.RecordBatch], ngram: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, n, fp, drawn, samples) of (doc_id, text); key is a 128-bit hash of the
    set of n shingles, the same for texts with the same set."""
    times = odd_numbers(tables * SAMPLE, SEED)
    back = inverses(times)
    for part in slices(batches, 500):
        sets = [shingle_set(t, ngram) for t in part.column("text").to_pylist()]
        drawn = np.array([samples(s, times, back) for s in sets], dtype=np.uint64).reshape(len(sets), len(times))
        prints = sample_prints(drawn, tables).view(np.int64)
        columns = [
            part.column("doc_id"),
            pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array(np.array([whole_print(s) for s in sets], dtype=np.uint64).view(np.int64)),
            pa.array([m.tobytes() for m in marks(drawn)], pa.binary()),
            pa.array([list(p) if len(s) else [] for s, p in zip(sets, prints)], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "fp", "drawn", "samples"])


def keyed_sets(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    """(key, shingles) of (doc_id, text)."""
    for part in slices(batches, 100):
        sets = [shingle_set(t, ngram) for t in part.column("text").to_pylist()]
        keys = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])
