"""Operator 5: exact substring dedup with fixed-block anchors.

Words of every document that stand in a window of WINDOW words which also starts in
a document with a smaller doc_id are removed. The reference side indexes
non-overlapping blocks of half a window at fixed places, since every window holds
one whole block. Every rolling half-window of every document probes that index, and
what was hit is extended: all full windows around a hit are compared by a 64-bit
fingerprint within a bucket of another hash (64 bits and the logarithm of the number of
parts in all), and windows in a row make up the maximal repeats that are cut out.

The work runs over parts: documents dealt out by a hash of doc_id, some megabytes of
text each. A part sends each distinct hash once, however many of its documents have
it, so that a passage which a third of all documents share is one entry per part:

1. part -> bucket: distinct rolling hashes, with flags "starts a block" and "in more
   than one document here". Packed bytes, about four per hash, no row per word.
2. bucket -> part: hashes that start a block somewhere and are in two documents.
3. part -> bucket: fingerprints of full windows around hits, with the smallest doc_id.
4. bucket -> part: the smallest doc_id over all parts, where it can matter.
5. part: the words that windows with a smaller doc_id cover are removed.

Defined results: null or empty text has no words (kept_sha256 of the empty string);
rows without doc_id are left out; repeated rows with one doc_id are one document to
each other, so they never remove each other's words; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, release, written

WINDOW = 50
#: Characters of text in one part, on average.
PART_CHARS = 8_000_000
#: Bytes whose word hashes are computed at a time.
SEGMENT = 1 << 20

U = np.uint64
#: Odd multipliers of the rolling sums, for bytes, words, and words a second time.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mixed(np.arange(1, 257, dtype=U) * U(BYTE_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def sliding(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The sum of values[i] * base**(i - start) over each range, modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(pow(base, -1, 2**64), len(values) + 1)[starts]


class Words:
    """The words of some documents in a row: document, place in it, and hash of each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.r_[0, edge]
        starts, ends = edge[::2], edge[1::2]
        doc_ends = np.cumsum([len(b) + 1 for b in raw])
        self.doc = np.searchsorted(doc_ends, starts, side="right")
        self.counts = np.bincount(self.doc, minlength=len(raw)) if len(raw) else np.zeros(0, dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]].astype(np.int64) if len(raw) else np.zeros(0, dtype=np.int64)
        self.place = np.arange(len(starts)) - self.first[self.doc]
        self.code = np.empty(len(starts), dtype=U)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT)))
            base = starts[at]
            self.code[at:to] = mixed(sliding(BYTE_CODE[data[base : ends[to - 1]]], starts[at:to] - base, ends[at:to] - base, BYTE_BASE) + (ends[at:to] - starts[at:to]).astype(U))
            at = to

    def starts(self, size: int) -> np.ndarray:
        """Indices of the words at which a window of so many words starts."""
        return np.flatnonzero(self.place + size <= self.counts[self.doc])

    def hashes(self, at: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        code = mixed(self.code ^ U(WORD_BASE_2)) if second else self.code
        return mixed(sliding(code, at, at + size, WORD_BASE_2 if second else WORD_BASE))


def scaled(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash out of n, and the next 32 bits; both keep the order."""
    low = (h & U(0xFFFFFFFF)) * U(n) >> U(32)
    return ((h >> U(32)) * U(n) + low >> U(32)).astype(np.int64), (h * U(n) >> U(32)).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Bytes of x by significance, which compress well if x is in order or small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool)


def runs(x: np.ndarray) -> np.ndarray:
    """Where a new value starts in x, which is in order."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)


def slices(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of x, which is in order, and where it stands."""
    at = runs(x)
    for a, b in zip(at, np.append(at[1:], len(x))):
        yield int(x[a]), slice(a, b)


def spread(per: pd.Series, sizes: list[int]) -> np.ndarray:
    return np.repeat(per.to_numpy(dtype=np.int64), sizes)


def substring_dedup(docs: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and the kept words as text if asked for."""
    block = window // 2
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))

    def probe(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        words = Words(docs["text"].tolist())
        at = words.starts(block)
        h = words.hashes(at, block)
        order = np.argsort(h)
        h, ids = h[order], docs["doc_id"].to_numpy()[words.doc[at][order]]
        new = runs(h)
        rows = []
        if len(h):
            anchor = np.logical_or.reduceat(words.place[at][order] % block == 0, new)
            several = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new)
            bucket, rest = scaled(h[new], parts)
            rows = [(b, key[0], planes(rest[s]), np.packbits(anchor[s]).tobytes(), np.packbits(several[s]).tobytes()) for b, s in slices(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "part", "rest", "anchor", "several"])

    def match(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(b) // 4 for b in sent["rest"]]
        rest = np.concatenate([unplanes(b, np.uint32) for b in sent["rest"]])
        anchor, several = (np.concatenate([bits(b, n) for b, n in zip(sent[c], sizes)]) for c in ("anchor", "several"))
        order = np.argsort(rest, kind="stable")
        new = runs(rest[order])
        times = np.diff(np.append(new, len(rest)))
        hit = np.logical_or.reduceat(anchor[order], new) & ((times > 1) | np.logical_or.reduceat(several[order], new))
        hit = np.repeat(hit, times)
        part, rest = spread(sent["part"], sizes)[order][hit], rest[order][hit]
        order = np.argsort(part, kind="stable")
        rows = [(p, key[0], planes(rest[order][s])) for p, s in slices(part[order])]
        return pd.DataFrame(rows, columns=["part", "bucket", "rest"])

    def extend(key: tuple, docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "part", "print", "doc", "several"]
        if not len(hits) or not len(docs):
            return pd.DataFrame([], columns=columns)
        known = np.sort(np.concatenate([(U(b) << U(32)) | unplanes(r, np.uint32).astype(U) for b, r in zip(hits["bucket"], hits["rest"])]))
        words = Words(docs["text"].tolist())
        at = words.starts(block)
        bucket, rest = scaled(words.hashes(at, block), parts)
        probed = (bucket.astype(U) << U(32)) | rest.astype(U)
        found = known[np.minimum(np.searchsorted(known, probed), len(known) - 1)] == probed
        before = np.zeros(len(words.code) + 1, dtype=np.int64)
        before[at[found] + 1] = 1
        before = np.cumsum(before)
        at = words.starts(window)
        at = at[before[at + window - block + 1] > before[at]]
        if not len(at):
            return pd.DataFrame([], columns=columns)
        bucket, _ = scaled(words.hashes(at, window), parts)
        second, ids = words.hashes(at, window, second=True), docs["doc_id"].to_numpy()[words.doc[at]]
        order = np.lexsort((second, bucket))
        bucket, second, ids = bucket[order], second[order], ids[order]
        new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (second[1:] != second[:-1])])
        least = np.minimum.reduceat(ids, new)
        several = least != np.maximum.reduceat(ids, new)
        bucket, second = bucket[new], second[new]
        rows = [(b, key[0], planes(second[s]), planes(least[s]), np.packbits(several[s]).tobytes()) for b, s in slices(bucket)]
        return pd.DataFrame(rows, columns=columns)

    def earliest(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(b) // 8 for b in sent["print"]]
        second = np.concatenate([unplanes(b, U) for b in sent["print"]])
        ids = np.concatenate([unplanes(b, np.int64) for b in sent["doc"]])
        several = np.concatenate([bits(b, n) for b, n in zip(sent["several"], sizes)])
        order = np.argsort(second, kind="stable")
        new = runs(second[order])
        times = np.diff(np.append(new, len(order)))
        least = np.repeat(np.minimum.reduceat(ids[order], new), times)
        told = (np.repeat(times, times) > 1) | several[order]
        part, second, least = spread(sent["part"], sizes)[order][told], second[order][told], least[told]
        order = np.argsort(part, kind="stable")
        rows = [(p, key[0], planes(second[order][s]), planes(least[order][s])) for p, s in slices(part[order])]
        return pd.DataFrame(rows, columns=["part", "bucket", "print", "doc"])

    def remove(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        words = Words(docs["text"].tolist())
        gone = np.zeros(len(words.code) + 1, dtype=np.int64)
        at = words.starts(window)
        if len(told) and len(at):
            known = np.concatenate([mixed(unplanes(p, U) + U(b)) for b, p in zip(told["bucket"], told["print"])])
            least = np.concatenate([unplanes(d, np.int64) for d in told["doc"]])
            order = np.argsort(known)
            known, least = known[order], least[order]
            bucket, _ = scaled(words.hashes(at, window), parts)
            seen = mixed(words.hashes(at, window, second=True) + bucket.astype(U))
            i = np.minimum(np.searchsorted(known, seen), len(known) - 1)
            at = at[(known[i] == seen) & (docs["doc_id"].to_numpy()[words.doc[at]] > least[i])]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        kept = np.cumsum(gone)[:-1] == 0
        rows = []
        for doc_id, text, first, n in zip(docs["doc_id"], docs["text"], words.first, words.counts):
            keep = kept[first : first + n]
            left = (text or "").encode("utf-8").split()
            if not keep.all():
                left = [left[i] for i in np.flatnonzero(keep)]
            left = b" ".join(left)
            rows.append((doc_id, n, n - int(keep.sum()), hashlib.sha256(left).hexdigest()) + ((left.decode("utf-8"),) if with_text else ()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    sent = dealt.groupBy("part").applyInPandas(probe, "bucket int, part int, rest binary, anchor binary, several binary")
    hits = written(sent.groupBy("bucket").applyInPandas(match, "part int, bucket int, rest binary"))
    del sent
    release(docs.sparkSession)
    sent = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInPandas(extend, "bucket int, part int, print binary, doc binary, several binary")
    told = written(sent.groupBy("bucket").applyInPandas(earliest, "part int, bucket int, print binary, doc binary"))
    discard(hits)
    del sent, hits
    release(docs.sparkSession)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(remove, schema)
