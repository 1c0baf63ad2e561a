"""Operator 4: SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are made of all shingles of the whole text. Equal fingerprints are one
class; the classes are searched for pairs at few differing bits by an index:

* The upper nodes are masked bit patterns that many fingerprints share. A root node
  holds the fingerprints that agree on one third of the bits (for two differing bits:
  at least one of three thirds agrees, so that every pair meets in some node). A node
  with more than NODE rows is divided the same way over its free bits, down to nodes
  whose free bits bound their size. Nodes are Spark's groups: one key each.
* In a node, fingerprints stand in Gray order. Runs of neighbours form inner nodes
  that keep only the bits all of them share and no ancestor has; a search goes down
  from the top, adds up differences, and leaves out a run as soon as they exceed the
  limit.

A node gives back a star for each set of linked fingerprints, not the pairs, and
components of the stars give the classes of the documents.

similar_classes() and deduplicated() link texts by the Jaccard similarity of their sets of
shingles instead; the index and SimHashes of samples give them candidates.

Defined results: null text or text without words has fingerprint zero and links like
any other; text with fewer words than a shingle is one shingle; repeated rows are
repeated in the result; rows without doc_id link like any other but name no component,
which is null where none of its rows has a doc_id; ids keep all their 64 bits; an empty
table gives no rows; other columns are ignored. For deduplicated(): rows without doc_id
all stay, repeated rows are one row, texts without words are similar to each other alone,
rows of one doc_id with several texts count as one text each and stay as one row of any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import shingles
from recordloom.llm.common import crossed, cut, dealt, discard, grouped, short_batches, shuffle_partitions, slices, written
from recordloom.llm.components import components

BITS = 64
MAX_BITS = 2
SEED = 42
#: Rows up to which a node is searched; larger ones are divided by more shared bits.
NODE = 4096
#: Neighbours in Gray order under one inner node.
FAN = 8
#: Queries that go down the tree at a time.
QUERIES = 512
#: Texts in one block of a bucket or candidate group.
BLOCK = 128
#: Share of the similarity that an estimate from 100 marks must reach: at a similarity of
#: 0.8 an estimate below 0.64 is four standard deviations off.
CLOSE = 0.8


def fingerprint(text: str | None, ngram: int, chunk: int = 1 << 15) -> int:
    """The SimHash of a text's word shingles, of XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < ngram:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - ngram + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(ngram))))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), grams), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, chunk):
        ones += np.unpackbits(hashes[at : at + chunk].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            fp = np.array([fingerprint(t, ngram) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def shared_masks(fixed: int, parts: int) -> list[int]:
    """The masks of a node's children: its own bits and one of parts runs of its free bits."""
    free = [1 << i for i in range(BITS) if not fixed >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [fixed | sum(free[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_tree(codes: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, own mask) from the top down, over codes in Gray order; the last
    level are the codes themselves. A node's own mask has the bits that all codes below
    it share, without those of its ancestors."""
    levels = [(codes, np.full(len(codes), 2**64 - 1, dtype=np.uint64))]
    while len(levels[0][0]) > fan:
        pattern, agree = levels[0]
        starts = np.arange(0, len(pattern), fan)
        first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
        agree = ~np.bitwise_or.reduceat((pattern ^ first) | ~agree, starts)
        levels.insert(0, (pattern[starts] & agree, agree))
    for depth in range(len(levels) - 1, 0, -1):
        pattern, agree = levels[depth]
        levels[depth] = (pattern, agree & ~np.repeat(levels[depth - 1][1], fan)[: len(pattern)])
    return levels


def gray_links(codes: np.ndarray, most: int, fan: int = FAN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i < j) of codes in Gray order at most so many bits apart."""
    levels = gray_tree(codes, fan)
    for at in range(0, len(codes), QUERIES):
        queries = np.arange(at, min(at + QUERIES, len(codes)))
        top = len(levels[0][0])
        query, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        apart = np.zeros(len(query), dtype=np.uint8)
        for depth, (pattern, own) in enumerate(levels):
            apart = apart + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
            near = apart <= most
            query, node, apart = query[near], node[near], apart[near]
            if depth + 1 < len(levels):
                size = len(levels[depth + 1][0])
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                query, apart = np.repeat(query, fan), np.repeat(apart, fan)
                inside = node < size
                query, node, apart = query[inside], node[inside], apart[inside]
        later = query < node
        yield query[later], node[later]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes label, of smallest linked indices, hold the links a to b as well."""
    while True:
        x, y = label[a], label[b]
        if (apart := x != y).any():
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]
        else:
            return


def stars(codes: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code linked to an earlier one, an edge from the set's first to it."""
    if len(codes) == 2:
        near = np.bitwise_count(codes[:1] ^ codes[1:]) <= most
        return ids[:1][near], ids[1:][near]
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, ids = codes[order], ids[order]
    label = np.arange(len(codes))
    for a, b in gray_links(codes, most):
        merge(label, a, b)
    other = label != np.arange(len(codes))
    return ids[label[other]], ids[other]


def solved(nodes: DataFrame, most: int) -> DataFrame:
    """The stars (src, dst) within each node of rows (mask, pattern, fp, id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            mask, pattern = rows["mask"].to_numpy(), rows["pattern"].to_numpy()
            codes, ids = rows["fp"].to_numpy().view(np.uint64), rows["id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            sizes = np.diff(np.append(starts, len(rows)))
            found = [stars(codes[s : s + n], ids[s : s + n], most) for s, n in zip(starts[sizes > 1], sizes[sizes > 1])]
            src, dst = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in (zip(*found) if found else ((), ())))
            return pd.DataFrame({"src": src, "dst": dst})

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["pattern"] == rows["pattern"].iloc[-1])
            rest, whole = rows[last], rows[~last]
            if len(whole):
                yield links(whole)
        if rest is not None:
            yield links(rest)

    spread = nodes.repartition(shuffle_partitions(nodes.sparkSession), "mask", "pattern").sortWithinPartitions("mask", "pattern")
    return spread.mapInPandas(run, "src long, dst long")


def near_pairs(codes: DataFrame, most: int = MAX_BITS, node: int = NODE) -> DataFrame:
    """Stars (src, dst) over ids that reach every pair of distinct fingerprints (fp, id)
    at most so many bits apart."""
    parts = most + 1
    level = shared_masks(0, parts)
    rows = codes.select("fp", "id", F.explode(F.array(*(F.lit(signed(m)) for m in level))).alias("mask"))
    rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    found = None
    while True:
        free = max(BITS - m.bit_count() for m in level)
        full = None
        if 2**free > node and free >= parts:
            full = cut(rows.groupBy("mask", "pattern").count().where(F.col("count") > node).drop("count"))
            if full.isEmpty():
                full = None
        here = solved(rows if full is None else rows.join(full, ["mask", "pattern"], "left_anti"), most)
        found = here if found is None else found.union(here)
        if full is None:
            return found
        below = {m: shared_masks(m, parts) for m in level}
        children = F.create_map(*(x for m, c in below.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(k)) for k in c)))))
        rows = rows.join(full, ["mask", "pattern"], "left_semi").select("fp", "id", F.explode(children[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        level = [k for c in below.values() for k in c]


def near_duplicates(docs: DataFrame, ngram: int = 3, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    prints = cut(fingerprints(docs, ngram))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_pairs(classes.select("fp", F.col("fp").alias("id")), most).where("src <> dst"))
    lookup = classes.join(groups, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("of"))
    names = lookup.groupBy("of").agg(F.min("least").alias("component_id"))
    return prints.join(lookup.join(names, "of").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def screened(rows: DataFrame, similarity: float) -> DataFrame:
    """Stars (src, dst) of keys that stand in one group and whose marks agree in so large a
    share; rows: unit, low, high, own, key, n, drawn."""
    keys = ["unit", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, groups in grouped(batches, keys):
            key, n, own = held.column("key").to_pylist(), held.column("n").to_numpy(), held.column("own").to_numpy()
            drawn = np.frombuffer(b"".join(held.column("drawn").to_pylist()), dtype="<u2").reshape(held.num_rows, -1)
            one_sided = held.column("low").to_numpy() == held.column("high").to_numpy()
            src, dst = [], []
            for a, b in groups:
                label = np.arange(a, b)
                for i in range(a, b - 1):
                    near = (drawn[i + 1 : b] == drawn[i]).sum(axis=1) >= CLOSE * similarity * drawn.shape[1]
                    near &= np.minimum(n[i + 1 : b], n[i]) >= similarity * np.maximum(n[i + 1 : b], n[i]) - 1e-9
                    if not one_sided[a]:
                        near &= own[i + 1 : b] != own[i]
                    if near.any():
                        others = np.flatnonzero(near) + i + 1 - a
                        local = label - a
                        merge(local, np.full(len(others), i - a), others)
                        label = local + a
                for at in np.flatnonzero(label != np.arange(a, b)):
                    src.append(key[label[at]])
                    dst.append(key[a + at])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.select(*keys, "own", "key", "n", "drawn").mapInArrow(run, "src binary, dst binary")


def set_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> np.ndarray:
    """For each of the sets (sorted numbers without repeats) the first one of those it is
    linked with by a Jaccard similarity; side: only sets of different sides are compared."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(code) + 1, dtype=np.int64)
    for i in range(len(sets) - 1):
        apart = label[i + 1 :] != label[i]
        if side is not None:
            apart &= side[i + 1 :] != side[i]
        apart &= np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9
        if not apart.any():
            continue
        own = code[ends[i] - size[i] : ends[i]]
        flag[own] = 1
        # sets are never empty here, so that each starts a stretch of its own
        both = np.add.reduceat(flag[code[ends[i] :]], ends[i:-1] - ends[i])
        flag[own] = 0
        near = apart & (both >= similarity / (1 + similarity) * (size[i + 1 :] + size[i]) - 1e-9)
        if near.any():
            others = np.flatnonzero(near) + i + 1
            merge(label, np.full(len(others), i), others)
    return label


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Stars (src, dst) of keys that stand in one group and whose sets are similar enough;
    rows: unit, low, high, own, key, shingles."""
    keys = ["unit", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, groups in grouped(batches, keys):
            key, raw, own = held.column("key").to_pylist(), held.column("shingles"), held.column("own").to_numpy()
            one_sided = held.column("low").to_numpy() == held.column("high").to_numpy()
            src, dst = [], []
            for a, b in groups:
                sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in raw.slice(a, b - a)]
                label = set_links(sets, None if one_sided[a] else own[a:b], similarity)
                for at in np.flatnonzero(label != np.arange(b - a)):
                    src.append(key[a + label[at]])
                    dst.append(key[a + at])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.select(*keys, "own", "key", "shingles").mapInArrow(run, "src binary, dst binary")


def grouped_links(rows: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of the keys that compare() links with another one; rows: unit, key,
    count (keys of the unit). compare() gives stars within the groups (unit, low, high).

    A unit of BLOCK keys or fewer is one group. A larger one is dealt out twice into random
    blocks, in which all that is linked densely comes together; then keys outside the unit's
    largest component so far are compared with all others of the unit, in blocks again. So
    each link is found or its ends have met already, and a unit of copies costs a few groups
    a block, not all pairs of its blocks.
    """
    stars = written(compare(dealt(rows, "key", BLOCK, 0)))
    large = written(rows.where(F.col("count") > BLOCK))
    if large.isEmpty():
        found = components(stars)
    else:
        more = written(compare(dealt(large, "key", BLOCK, 1)))
        found = components(stars.union(more))
        label = found.select(F.col("id").alias("key"), F.col("component").alias("of"))
        named = written(large.join(label, "key", "left").select("unit", "key", "count", F.coalesce("of", "key").alias("of")))
        sizes = named.groupBy("unit", "of").agg(F.count("*").alias("n"))
        most = sizes.groupBy("unit").agg(F.max(F.struct("n", "of")).alias("top")).select("unit", "top.n", F.col("top.of").alias("top"))
        apart = named.join(most, "unit").where(F.col("n") < F.col("count"))
        apart = apart.select("unit", "key", (F.col("of") != F.col("top")).alias("odd"), (F.col("count") - F.col("n")).alias("n_odd"), F.col("n").alias("n_even"))
        strays = written(compare(crossed(apart, "key", BLOCK)))
        if not strays.isEmpty():
            joined = found.select(F.col("id").alias("src"), F.col("component").alias("dst"))
            before, found = found, components(joined.union(strays))
            discard(before)
        for done in (more, named, strays):
            discard(done)
    for done in (stars, large):
        discard(done)
    return found


def similar_classes(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, most: int = MAX_BITS) -> DataFrame:
    """(key, id, component): for each distinct set of shingles its smallest doc_id and the
    smallest one that links reach, where sets of that Jaccard similarity or more link.

    Buckets are texts whose SimHash the index finds at most so many differing bits apart,
    and texts with an equal SimHash of one of the samples of their shingles: at a similarity
    of 0.8 whole SimHashes differ by ten bits, at which the index would prune nothing. Within
    a bucket the marks of the shingles drawn give an estimate for any two texts; those whose
    estimate comes near the similarity form candidate groups. Each candidate's set then goes
    to its group, where links are decided exactly. No pair is ever a row: buckets and groups
    give stars (grouped_links()).
    """
    short_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = text.mapInArrow(lambda b: shingles.signatures(b, ngram, shingles.TABLES), "doc_id long, key binary, n int, fp long, drawn binary, samples array<long>")
    first = F.min_by(F.struct("n", "fp", "drawn", "samples"), "doc_id").alias("s")
    classes = written(prints.groupBy("key").agg(F.min("doc_id").alias("id"), first).select("key", "id", "s.*"))

    whole = classes.where("n > 0").select("fp").distinct()
    stars = written(near_pairs(whole.select("fp", F.col("fp").alias("id")), most).where("src <> dst").distinct())
    around = stars.select("src", F.explode(F.array("src", "dst")).alias("fp")).distinct()
    in_stars = classes.where("n > 0").join(around, "fp").select(F.xxhash64(F.lit("star"), "src").alias("unit"), "key")
    equal = classes.where("n > 0").select(F.xxhash64(F.lit("whole"), "fp").alias("unit"), "key")
    met = classes.select(F.explode("samples").alias("unit"), "key").union(equal).union(in_stars)
    shared = met.groupBy("unit").agg(F.count("*").alias("count")).where("count > 1")
    members = written(met.join(shared, "unit"))
    discard(stars)
    marks = classes.select("key", "n", "drawn")
    near = grouped_links(members, lambda rows: screened(rows.join(marks, "key"), similarity))
    discard(members)

    groups = near.select(F.col("id").alias("key"), F.col("component").alias("of"))
    sizes = groups.groupBy("of").agg(F.count("*").alias("count"))
    units = written(groups.join(sizes, "of").select(F.xxhash64("of").alias("unit"), "key", "count"))
    wanted = groups.select("key")
    ids = wanted.join(classes, "key").select("id").distinct()
    sets = text.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(lambda b: shingles.keyed_sets(b, ngram), "key binary, shingles binary")
    sets = written(sets.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    label = grouped_links(units, lambda rows: compared(rows.join(sets, "key"), similarity))
    for done in (units, sets, near):
        discard(done)
    label = label.select(F.col("id").alias("key"), F.col("component").alias("of"))
    named = classes.select("key", "id").join(label, "key", "left").select("key", "id", F.coalesce("of", "key").alias("of"))
    return named.join(named.groupBy("of").agg(F.min("id").alias("component")), "of").select("key", "id", "component")


def deduplicated(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component of similar texts, one row
    each; rows without doc_id stay. Texts without words are similar to each other alone."""
    named = docs.where("doc_id is not null")
    first = similar_classes(named, ngram, similarity).select(F.col("component").alias("doc_id")).distinct()
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))
