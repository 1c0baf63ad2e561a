"""Operator 1: language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a binary classifier over
hashed letter n-grams is learned: the log odds of an n-gram under the languages with
+1 against those with -1. A text's margin for a bit is the sum of its n-grams' log
odds over the square root of their number, calibrated by a logistic fit. Decoding is
loss-weighted: the distance of a codeword is the logistic loss of all margins against
it, each weighted by how well that bit separates that language in the sample. The
nearest codeword wins; if the second one is nearly as probable, the text is ambiguous.

Counts of n-grams are fitted on a bounded sample: FIT_DOCS documents a language in
expectation, by a hash of doc_id. Every text is predicted whole. lang, source and
doc_id are no inputs of a prediction.

Defined results: null text and text without a letter is "und" with score 0; without any
learnable language every text is "und"; rows without doc_id are left out; repeated rows
are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import slices
from recordloom.llm.grams import hashed, letters, lower_letters

UNKNOWN = "und"
#: Documents of one language that the classifiers are fitted on, in expectation.
FIT_DOCS = 3000
BITS = 16
SMOOTH = 0.5
#: Languages up to which all possible bits are used.
EXHAUSTIVE = 6
#: Lead in probability below which a text is ambiguous.
LEAD = 0.2


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """One row of +1 and -1 for each of n languages."""
    if not n:
        return np.zeros((0, 0))
    if n <= EXHAUSTIVE:
        return np.array([[1 if k == 0 or not (b >> (k - 1)) & 1 else -1 for b in range(1, 2 ** (n - 1))] for k in range(n)]).reshape(n, -1)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, 10 * int(np.ceil(np.log2(n)))))
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > most and (abs(code.sum(axis=0)) < n).all():
            best, most = code, least
    return best


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def margins(texts: list[str | None], table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights over root of number of n-grams for each text, and whether it has a letter."""
    codes = [letters(t or "", table) for t in texts]
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for whose, bucket in hashed(codes, BITS):
        at = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else []
        if len(at):
            total[whose[at]] += np.add.reduceat(weights[bucket], at, axis=0)
            count[whose[at]] += np.diff(np.r_[at, len(whose)])
    return total / np.sqrt(count + 1)[:, None], np.array([bool((c != 32).any()) for c in codes], dtype=bool)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y (0 or 1) on x."""
    a = np.c_[x, np.ones(len(x))]
    scale = np.abs(x).mean() + 1e-9
    a[:, 0] /= scale
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        v = p * (1 - p) + 1e-6
        w = w + np.linalg.solve((a * v[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
    return w[0] / scale, w[1]


class Model:
    """What a fit has learned; decode() gives language, score and ambiguity of margins."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True) if len(languages) else counts
        plus, minus = (self.code > 0).astype(float), (self.code < 0).astype(float)
        self.weights = np.log((plus / plus.sum(axis=0)).T @ share / ((minus / minus.sum(axis=0)).T @ share)).T.astype(np.float32) if len(languages) > 1 else np.zeros((1 << BITS, 1), dtype=np.float32)
        self.slope, self.offset = np.ones(self.code.shape[1]), np.zeros(self.code.shape[1])
        self.trust = np.ones(self.code.shape)

    def calibrate(self, margin: np.ndarray, language: np.ndarray) -> None:
        for b in range(self.code.shape[1]):
            y = (self.code[language, b] > 0).astype(float)
            self.slope[b], self.offset[b] = logistic(margin[:, b], y)
        sign = np.sign(margin * self.slope + self.offset)
        for k in range(len(self.languages)):
            own = sign[language == k]
            if len(own):
                self.trust[k] = np.maximum((own == self.code[k]).mean(axis=0), 0.05)
        self.trust *= self.code.shape[1] / self.trust.sum(axis=1, keepdims=True)

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.languages) < 2:
            n = len(margin)
            return np.zeros(n, dtype=int), np.ones(n), np.zeros(n, dtype=bool)
        f = margin * self.slope + self.offset
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust[None]
        apart = loss.sum(axis=2)
        # a codeword's bits outnumber the independent evidence for it
        p = np.exp(-(apart - apart.min(axis=1, keepdims=True)) * np.log2(len(self.languages)) / self.code.shape[1])
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(axis=1), p.max(axis=1), top[:, -1] - top[:, -2] < LEAD


def fitted(learn: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model of the rows (doc_id, text, lang) to learn from."""
    sizes = learn.groupBy("lang").count().withColumn("part", F.least(F.lit(1.0), fit_docs / F.col("count"))).select("lang", "part").toPandas()
    languages = sorted(sizes["lang"])
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)))
    part = F.create_map(*(F.lit(v) for row in sizes.itertuples(index=False) for v in (row.lang, float(row.part))))
    luck = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / 1e6
    sample = learn.where(luck < part[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sums = lower_letters(), {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                texts = group["text"].tolist()
                for at in range(0, len(texts), 100):
                    for _, bucket in hashed([letters(t or "", table) for t in texts[at : at + 100]], BITS):
                        total += np.bincount(bucket, minlength=1 << BITS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": total[some]})

    counts = np.zeros((len(languages), 1 << BITS))
    summed = sample.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = summed.toPandas()  # at most one row for each language and bucket
    counts[summed["lang"].map({x: i for i, x in enumerate(languages)}), summed["bucket"]] = summed["n"]
    model = Model(languages, counts)
    if len(languages) > 1:
        weights = learn.sparkSession.sparkContext.broadcast(model.weights)

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = lower_letters()
            for batch in batches:
                for at in range(0, len(batch), 200):
                    p = batch.iloc[at : at + 200]
                    m, some = margins(p["text"].tolist(), table, weights.value)
                    if some.any():
                        yield pd.DataFrame({"lang": p["lang"].to_numpy()[some], "m": list(m[some])})

        seen = sample.select("lang", "text").mapInPandas(measure, "lang string, m array<double>").toPandas()
        if len(seen):
            model.calibrate(np.array(seen["m"].tolist()), seen["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy())
    return model


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = lower_letters(), Model.__new__(Model)
        vars(model).update(shared.value)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for part in slices(batches, 200):
            m, some = margins(part.column("text").to_pylist(), table, model.weights)
            if not model.languages:
                some[:] = False
            which, score, close = model.decode(m)
            new = [pa.array(names[np.where(some, which, -1)], pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(some & close)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *new], ["row", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.struct(*keep).alias("row"), "text")
    got = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return got.select("row.*", "lang_pred", "score", "ambiguous")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): learned from the rows not held out."""
    docs = docs.where("doc_id is not null")
    out = held_out(F.col("doc_id"))
    model = fitted(docs.where(~out & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return predicted(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
