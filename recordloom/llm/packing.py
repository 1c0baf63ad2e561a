"""Operator 3: best-two-fit packing of tokenized documents into sequences.

Every document becomes its token ids followed by one end id. Documents longer
than a sequence are cut into full pieces and a shorter last one. Pieces are dealt
out over groups of bounded size by a hash of their identity, and each group is
packed by best-two-fit: a bin is filled greedily with the longest piece that still
fits; then its smallest piece is exchanged for the two unpacked pieces that fill
the grown gap most tightly, if such a pair is longer than what it replaces.

Only lengths take part in the packing, so that no group holds text. A group wastes
at most its own last bins, less than one sequence in a thousand at the default size.

Defined results: null or empty text is the end id alone; repeated rows are packed
as often as they occur; rows without doc_id are packed like any other and keep a null id;
ids keep all their 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Documents that one packing group holds on average.
GROUP_DOCS = 40_000
#: Bytes of text that are encoded together.
SLICE = 16_000_000
#: Characters whose words are their own normal form, letter case aside; the vocabulary's
#: pre-tokenizer (fixed value, from its file) takes letters in a row, single digits, and
#: other characters in a row as pieces, and splits after an apostrophe in its own way.
PLAIN = "^[\\x21-\\x26\\x28-\\x7e\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]*$"
LETTERS_OR_DIGIT = "([a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]+|[0-9])"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and sizes, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class WordTokenizer:
    """Encodes the distinct words of many texts, and puts texts together from them.

    The vocabulary's pre-tokenizer never joins characters across a blank or a line
    feed, so the ids of a text are those of its words one after the other. Plain words
    are split into the pre-tokenizer's pieces; distinct pieces are encoded together,
    and the marked last token of each tells them apart. Any other word goes through
    the tokenizer by itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        got = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *got]), np.array([len(x) for x in got], dtype=np.int64)

    def together(self, pieces: list[str], at_once: int = 5000) -> tuple[np.ndarray, np.ndarray]:
        """What each() gives, for pieces that the pre-tokenizer leaves whole."""
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(pieces), at_once):
            part = pieces[i : i + at_once]
            got = self.ids(" ".join(part))
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(part) and ends[-1] == len(got):
                n = np.diff(ends, prepend=0)
            else:
                got, n = self.each(part)
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        spaced = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), LETTERS_OR_DIGIT, " \\1 ")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        some = np.array([bool(p) for p in pieces], dtype=bool)
        flat, n = self.together([p for p in pieces if p])
        sizes = np.zeros(len(pieces), dtype=np.int64)
        sizes[some] = n
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        done = gathered(flat, starts[index], sizes[index])
        ends = np.r_[0, np.cumsum(sizes[index])][split.offsets.to_numpy()]
        plain = plain.to_numpy(zero_copy_only=False)
        odd, odd_sizes = self.each(words.filter(pa.array(~plain)).to_pylist())
        out_sizes = np.zeros(len(words), dtype=np.int64)
        out_sizes[plain], out_sizes[~plain] = np.diff(ends), odd_sizes
        out_starts = np.zeros(len(words), dtype=np.int64)
        out_starts[plain], out_starts[~plain] = ends[:-1], len(done) + np.cumsum(odd_sizes) - odd_sizes
        return gathered(np.concatenate([done, odd]), out_starts, out_sizes), out_sizes

    def encode(self, texts: pa.Array, docs: int = 500) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        flat, sizes = self.words(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        index, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
        for at in range(0, len(texts), docs):
            own = ends[at : at + docs + 1] - ends[at]
            words = index[ends[at] : ends[min(at + docs, len(texts))]]
            ids = gathered(flat, starts[words], sizes[words])
            cuts = np.r_[0, np.cumsum(sizes[words])][own]
            for a, b in zip(cuts, cuts[1:]):
                yield ids[a:b]


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            sent = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // SLICE
            cuts = np.r_[0, np.flatnonzero(np.diff(sent)) + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, rows = batch.slice(a, b - a), []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(part.column("text"))):
                    ids = np.concatenate([ids, end])
                    for k, begin in enumerate(range(0, len(ids), size)):
                        piece = ids[begin : begin + size]
                        rows.append((doc_id, k, begin, len(piece), zlib.crc32(piece.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; lengths are 1 to size."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2))
    count = np.diff(ends).tolist()  # count[n]: unpacked pieces of length n
    mask = sum(1 << n for n, c in enumerate(count) if c)  # bit n: some are left
    mirror = sum(1 << (size - n) for n, c in enumerate(count) if c)  # bit size-n, for sums
    free = [list(range(ends[n], ends[n + 1])) for n in range(size + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)

    def take(n: int) -> None:
        nonlocal mask, mirror
        count[n] -= 1
        if not count[n]:
            mask &= ~(1 << n)
            mirror &= ~(1 << (size - n))

    def put_back(n: int) -> None:
        nonlocal mask, mirror
        count[n] += 1
        mask |= 1 << n
        mirror |= 1 << (size - n)

    def pair(most: int, over: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is as near to most as can be, and above over."""
        for total in range(most, over, -1):
            both = mask & (mirror >> (size - total))
            if total % 2 == 0 and count[total // 2] == 1:
                both &= ~(1 << (total // 2))
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None

    number = 0
    while mask:
        chosen, gap = [], size
        while fits := mask & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            take(n)
            chosen.append(n)
            gap -= n
        if gap and mask and (two := pair(gap + chosen[-1], chosen[-1])):
            put_back(chosen.pop())
            for n in two:
                take(n)
                chosen.append(n)
        at = 0
        for n in chosen:
            i = order[free[n].pop()]
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces with their place: sequence_id and offset beside what pieces() has."""
    groups = max(1, -(-docs.count() // group_docs))
    dealt = pieces(docs, path, size, end_id).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        # Arrow keeps ids whole beside nulls; in pandas such a column would be of doubles
        group = group.drop_columns("part").sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        bins, offsets = best_two_fit(group.column("length").to_numpy(), size)
        out = group.append_column("sequence_id", pa.array(bins * groups + key[0].as_py()))
        return out.append_column("offset", pa.array(offsets))

    return dealt.groupBy("part").applyInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
