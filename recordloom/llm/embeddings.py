"""Operator 7: near-duplicate vectors by random-hyperplane signs in several tables.

Equal vectors of one label are one class with a count, so that copies never meet as
pairs. Each class gets one signature of sign bits per table; classes of one label with
the same signature in a table are compared by their exact cosine in double precision.
A pair is counted in the first table in which it meets. The number of tables follows
from the number of bits: a pair at the threshold is missed with probability MISS at
most, closer pairs less. The number of bits grows with the number of classes, so that
a bucket's expected size stays as it is.

Buckets larger than BLOCK are divided: every pair of blocks is a group of its own, and
a group gives back counts per class and a star per set of linked classes, never pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components,
and rows without label link with nothing, and are their own component; vectors of
different length are not compared; rows without vec_id are left out; repeated rows are
repeated and link with each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut, shuffle_partitions
from recordloom.llm.components import components
from recordloom.llm.simhash import merge

THRESHOLD = 0.93
MISS = 0.001
SEED = 7
#: Classes in a bucket that the number of bits aims at, and the least and most bits.
BUCKET, LEAST_BITS, MOST_BITS = 256, 6, 30
#: Rows of a bucket in one block.
BLOCK = 1024
KEYS = ["label", "size", "table", "bucket"]


def tables_for(classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables for so many classes."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(classes, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One number of so many sign bits for each row and table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def group_links(x: np.ndarray, sign: np.ndarray, side: np.ndarray | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at the threshold or closer that meet in no earlier table; side: only
    pairs of different sides."""
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    new = ~(sign[a, :table] == sign[b, :table]).any(axis=1)
    if side is not None:
        new &= side[a] != side[b]
    return a[new], b[new]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    vectors = vectors.select("vec_id", "embedding", "label").where("vec_id is not null")
    unfit = F.expr("exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(embedding, x -> x = 0)")
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(unfit, F.lit(True))
    classes = cut(vectors.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    bits, tables = tables_for(classes.count(), threshold)
    # vectors travel as they came, and are scaled to length one where they are compared
    kind = np.float32 if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["size"] = batch["embedding"].map(len)
            for size, part in batch.groupby("size"):
                for at in range(0, len(part), 1000):
                    p = part.iloc[at : at + 1000]
                    x = np.array(p["embedding"].tolist(), dtype=kind)
                    s = signatures(unit(x.astype(np.float64)), bits, tables)
                    m = len(p)
                    yield pd.DataFrame(
                        {
                            "label": np.tile(p["label"], tables),
                            "size": size,
                            "table": np.repeat(np.arange(tables), m),
                            "bucket": s.T.ravel(),
                            "rep": np.tile(p["rep"], tables),
                            "n": np.tile(p["n"], tables),
                            "sign": [r.tobytes() for r in s.astype(np.int32)] * tables,
                            "x": [r.tobytes() for r in x] * tables,
                        }
                    )

    label = classes.schema["label"].dataType.simpleString()
    rows = classes.mapInPandas(sign, f"label {label}, size int, table int, bucket long, rep long, n long, sign binary, x binary")
    full = cut(rows.groupBy(*KEYS).count().where(F.col("count") > BLOCK).select(*KEYS, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(full, KEYS, "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    keys = [*KEYS, "low", "high"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            src, dst, links = [], [], []
            for key, g in rows.groupby(keys, sort=False):
                if len(g) < 2:
                    continue
                x = unit(np.frombuffer(b"".join(g["x"]), dtype=kind).reshape(len(g), -1).astype(np.float64))
                s = np.frombuffer(b"".join(g["sign"]), dtype=np.int32).reshape(len(g), -1)
                a, b = group_links(x, s, None if key[4] == key[5] else g["own"].to_numpy(), key[2], threshold)
                if not len(a):
                    continue
                rep, n = g["rep"].to_numpy(), g["n"].to_numpy()
                count = np.bincount(a, n[b], len(g)) + np.bincount(b, n[a], len(g))
                some = np.flatnonzero(count)
                tree = np.arange(len(g))
                merge(tree, a, b)
                leaf = np.flatnonzero(tree != np.arange(len(g)))
                src += [rep[some], rep[tree[leaf]]]
                dst += [np.full(len(some), -1), rep[leaf]]
                links += [count[some].astype(np.int64), np.zeros(len(leaf), dtype=np.int64)]
            cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, dtype=np.int64)
            return pd.DataFrame({"edge": cat([np.full(len(v), k % 2) for k, v in enumerate(src)]) > 0, "src": cat(src), "dst": cat(dst), "links": cat(links)})

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = np.logical_and.reduce([(rows[k] == rows[k].iloc[-1]).to_numpy() for k in keys])
            rest, whole = rows[last], rows[~last]
            if len(whole):
                yield solve(whole)
        if rest is not None:
            yield solve(rest)

    met = rows.repartition(shuffle_partitions(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
    met = cut(met.mapInPandas(compare, "edge boolean, src long, dst long, links long"))
    counts = met.where("not edge").groupBy("src").agg(F.sum("links").alias("links"))
    groups = components(met.where("edge").select("src", "dst"))
    found = classes.join(counts, F.col("rep") == F.col("src"), "left").join(groups, F.col("rep") == F.col("id"), "left")
    found = found.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = vectors.where(fit).join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
