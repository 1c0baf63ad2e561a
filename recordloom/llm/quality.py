"""Operator 6: quality classifier by co-training of two views.

The content view sees hashed character n-grams of the whole text and measures of its words
and lines. The metadata view sees what stands beside the text: language, source and n_chars.
Each view has a logistic classifier, calibrated on a fold of labelled documents that no
classifier has seen. In each round every document without a label is scored by both views;
those of which a view is sure, by its calibrated probability, are pseudo-labels for the
other view. A view that knows little is never sure and hands on nothing. At last the fold
calibrates the combination of both views. The threshold is one half, or less where the
good documents of the fold lie lower: SPREADS robust deviations under their median, so
that a few wrong labels can't pull it down.

Bounds: LABELLED labelled documents are learned from, and DRAWN pseudo-labels of each kind
and view a round, both in expectation and by a hash of doc_id. All else covers every
document: features are computed once and kept in a byte each, their means and scales come
from all rows, every round scores all rows, and every document is scored whole.

Defined results: null text counts as empty, null language, source or n_chars as a value of
its own; null labels are no labels, and of several labels of a document the lowest holds;
with labels of one value only, or none, every document is kept with score 1; rows
without doc_id are scored too; repeated rows are repeated; an empty table gives no
rows; other columns are ignored by scored() and kept by accepted(); without a column
n_chars it counts as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, short_batches, slices, written
from recordloom.llm.grams import code_points, hashed

#: Bounds, in expectation, of what the classifiers are fitted on.
LABELLED, DRAWN = 4000, 1000
#: Content buckets (a power of two), metadata columns for language and source, and for size.
BITS, HASHED, SIZES = 10, 32, 24
ROUNDS = 3
#: Calibrated probability from which a view is sure.
SURE = 0.95
FOLD = 0.25
#: Robust deviations (of log odds) under the median of good documents that still pass.
SPREADS = 4.0
#: Steps of a content feature to 1, and the columns of measures.
STEPS, MEASURES = 40, 10


def ngrams(texts: list[str | None]) -> np.ndarray:
    """Rows of log-scaled shares of hashed n-grams."""
    out = np.zeros((len(texts), 1 << BITS))
    size = 1 << BITS
    for whose, bucket in hashed([code_points(t or "") for t in texts], BITS):
        at = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else []
        for a, b in zip(at, np.r_[at[1:], len(whose)] if len(at) else []):
            out[whose[a]] += np.bincount(bucket[a:b], minlength=size)
    return np.log1p(1000 * out / (out.sum(axis=1, keepdims=True) + 50))


def measures(text: str | None) -> list[float]:
    """Each in a range of 0 to 6 or so, as the n-grams."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, chars = max(len(words), 1), max(len(text), 1)
    plain = text.encode("utf-8", "replace")
    upper = sum(map(plain.count, (b"A", b"E", b"I", b"N", b"O", b"R", b"S", b"T")))
    lower = sum(map(plain.count, (b"a", b"e", b"i", b"n", b"o", b"r", b"s", b"t")))
    marks = sum(map(plain.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!")))
    return [
        np.log1p(chars) / 3, np.log1p(n) / 3, 2 * np.log(chars / n), 5 * len(set(words)) / n, np.log1p(len(lines)) / 2, np.log1p(n / max(len(lines), 1)),
        5 * len(set(lines)) / max(len(lines), 1), 5 * upper / (upper + lower + 1), np.log1p(100 * marks / chars), max(map(len, words), default=0) ** 0.5,
    ]


def content(texts: list[str | None]) -> np.ndarray:
    """The content view of each text, a byte a feature."""
    both = np.c_[ngrams(texts), np.array([measures(t) for t in texts]).reshape(len(texts), MEASURES)]
    return np.minimum(np.rint(both * STEPS), 255).astype(np.uint8)


def slot(value: str | None) -> int:
    return zlib.crc32(b"\0" if value is None else value.encode("utf-8")) % HASHED


def metadata(langs: list[str | None], sources: list[str | None], chars: list[int | None]) -> np.ndarray:
    """The metadata view, a byte a feature; sizes by powers of two, null as the last one."""
    out = np.zeros((len(langs), 2 * HASHED + SIZES), dtype=np.uint8)
    at = np.arange(len(langs))
    out[at, [slot(x) for x in langs]] = STEPS
    out[at, [HASHED + slot(x) for x in sources]] = STEPS
    out[at, [2 * HASHED + (SIZES - 1 if x is None else min(max(int(x), 0).bit_length(), SIZES - 2)) for x in chars]] = STEPS
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(a: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic fit on few columns, by Newton's method."""
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = sigmoid(a @ w)
        v = p * (1 - p) + 1e-6
        w = w + np.linalg.solve((a * v[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
    return w


class View:
    """A logistic classifier on standardised features, with the calibration of its margins."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.w = np.zeros(len(mean) + 1, dtype=np.float32)
        self.line = np.zeros(2)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.05, ridge: float = 0.01) -> None:
        """Goes on from the present weights; both classes weigh the same in all."""
        a = np.ones((len(x), len(self.w)), dtype=np.float32)
        np.subtract(x, self.mean, out=a[:, :-1])
        a[:, :-1] /= self.scale
        v = weight * np.where(y > 0, 0.5 / max(weight[y > 0].sum(), 1e-9), 0.5 / max(weight[y <= 0].sum(), 1e-9))
        m, s = np.zeros_like(self.w), np.zeros_like(self.w)
        for k in range(1, steps + 1):
            g = a.T @ (v * (sigmoid(a @ self.w) - y)).astype(np.float32) + ridge * np.r_[self.w[:-1], 0] / len(self.w)
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            self.w = self.w - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
            self.w = self.w.astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        m = self.margin(x)
        scale = m.std() + 1e-6
        self.line = logistic(np.c_[m / scale, np.ones(len(m))], y) / np.array([scale, 1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x) * self.line[0] + self.line[1])


class Model:
    """Two co-trained views, their calibrated combination, and a threshold."""

    def __init__(self, x: list[np.ndarray], y: np.ndarray, fold: np.ndarray, scales: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.y, self.fold = x, y, fold
        self.views = [View(*s) for s in scales]
        self.learn([(a[:0], np.zeros(0)) for a in x])

    def learn(self, given: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Goes on with the labelled rows and pseudo-labels (rows, labels) for each view."""
        own = ~self.fold
        for view, x, (rows, labels) in zip(self.views, self.x, given):
            view.fit(np.concatenate([x[own], rows]), np.r_[self.y[own], labels], np.r_[np.ones(own.sum()), np.full(len(rows), 0.5)])
            view.calibrate(x[self.fold], self.y[self.fold])

    def combine(self) -> None:
        """Fits the combination and the threshold, and lets go of the rows."""
        margins = self.margins([a[self.fold] for a in self.x])
        self.centre, self.spread = margins.mean(axis=0), margins.std(axis=0) + 1e-6
        self.joint = logistic(np.c_[(margins - self.centre) / self.spread, np.ones(len(margins))], self.y[self.fold])
        good = self.odds([a[self.fold] for a in self.x])[self.y[self.fold] > 0]
        low = np.median(good) - SPREADS * 1.4826 * np.median(np.abs(good - np.median(good)))
        self.threshold = float(min(0.5, sigmoid(low)))
        del self.x, self.y, self.fold

    def margins(self, x: list[np.ndarray]) -> np.ndarray:
        return np.stack([view.margin(a) for view, a in zip(self.views, x)], axis=1)

    def odds(self, x: list[np.ndarray]) -> np.ndarray:
        return np.c_[(self.margins(x) - self.centre) / self.spread, np.ones(len(x[0]))] @ self.joint

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.odds(x))


def luck(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) / 1e6


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, c, m) of every row of docs: both views' features, a byte each, kept as Parquet."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200):
            views = viewed(*(part.column(c).to_pylist() for c in COLUMNS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in views)], ["doc_id", "c", "m"])

    return written(needed(docs, ["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, c binary, m binary"))


COLUMNS = ("text", "lang", "source", "n_chars")


def needed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs with the columns keep and all that the views read."""
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(None).cast("long"))
    return docs.select(*keep, *(c for c in COLUMNS if c not in keep))


def viewed(texts: list, langs: list, sources: list, chars: list) -> list[np.ndarray]:
    return [content(texts), metadata(langs, sources, chars)]


def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of a batch of featured()."""
    return [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1).astype(np.float32) for k in ("c", "m")]


def scales(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of every feature of each view over all rows: sums by feature, partial first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for part in slices(batches, 250):
            both = np.concatenate(unpacked(part), axis=1).astype(np.float64)
            more = np.stack([both.sum(axis=0), (both * both).sum(axis=0)])
            n, sums = n + part.num_rows, more if sums is None else sums + more
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1]), pa.int32()), pa.array(np.full(sums.shape[1], n)), pa.array(sums[0]), pa.array(sums[1])], ["at", "n", "s", "ss"])

    got = rows.select("c", "m").mapInArrow(run, "at int, n long, s double, ss double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).toPandas()
    got = got.sort_values("at")  # one row a feature
    mean = (got["s"] / got["n"]).to_numpy()
    scale = np.sqrt(np.maximum((got["ss"] / got["n"]).to_numpy() - mean**2, 0)) + 2
    wide = (1 << BITS) + MEASURES
    return [(mean[:wide], scale[:wide]), (mean[wide:], scale[wide:])]


def surely(rows: DataFrame, views: list[View]) -> DataFrame:
    """rows with sure_c and sure_m: what each view labels them, null if it is not sure."""
    shared = rows.sparkSession.sparkContext.broadcast([vars(v) for v in views])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [View.__new__(View) for _ in shared.value]
        for view, state in zip(own, shared.value):
            vars(view).update(state)
        for part in slices(batches, 250):
            told = [view.probability(x) for view, x in zip(own, unpacked(part))]
            sure = [pa.array(p > 0.5, mask=(p < SURE) & (p > 1 - SURE)) for p in told]
            yield pa.RecordBatch.from_arrays([*part.columns, *sure], [*part.schema.names, "sure_c", "sure_m"])

    return rows.mapInArrow(run, "doc_id long, c binary, m binary, sure_c boolean, sure_m boolean")


def exchanged(rows: DataFrame, views: list[View], salt: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view, rows of its features and the labels that the other one is sure of."""
    sure = surely(rows, views)
    kinds = [("sure_m", True), ("sure_m", False), ("sure_c", True), ("sure_c", False)]
    many = sure.agg(*(F.count_if(F.col(k) == v).alias(f"n{i}") for i, (k, v) in enumerate(kinds))).first()
    # DRAWN rows of each kind in expectation, whatever the input
    drawn = [(F.col(k) == v) & (luck(salt + str(i)) < DRAWN / max(many[i], 1)) for i, (k, v) in enumerate(kinds)]
    got = sure.select("doc_id", "c", "m", *(F.coalesce(d, F.lit(False)).alias(f"d{i}") for i, d in enumerate(drawn))).where("d0 or d1 or d2 or d3").toPandas()
    got = got.sort_values(["doc_id", "c"], ignore_index=True)
    out = []
    for name, yes, no in (("c", "d0", "d1"), ("m", "d2", "d3")):
        part = got[got[yes] | got[no]]
        x = np.frombuffer(b"".join(part[name]), dtype=np.uint8).reshape(len(part), -1 if len(part) else len(views[len(out)].mean)).astype(np.float32)
        out.append((x, part[yes].to_numpy(dtype=float)))
    return out


def fitted(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model of rows (featured()) and labels (doc_id, quality); None if labels don't have two values."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").cast("double").alias("quality"))
    marks = marks.withColumn("doc_id", F.col("l_id"))
    # LABELLED rows in expectation: its size is bounded whatever the input
    marks = F.broadcast(marks.where(luck("label") < LABELLED / max(marks.count(), 1)).drop("doc_id"))
    both = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    got = both.where("quality is not null").withColumn("fold", luck("fold") < FOLD).toPandas()
    got = got.sort_values(["doc_id", "c"], ignore_index=True)
    y, fold = (got["quality"].to_numpy() > 0).astype(float), got["fold"].to_numpy(dtype=bool)
    if any(len(set(y[f])) < 2 for f in (fold, ~fold)):
        fold = np.arange(len(y)) % 4 == 0
    if any(len(set(y[f])) < 2 for f in (fold, ~fold)):
        return None
    x = [np.frombuffer(b"".join(got[k]), dtype=np.uint8).reshape(len(got), -1).astype(np.float32) for k in ("c", "m")]
    model = Model(x, y, fold, scales(rows))
    pool = both.where("quality is null").drop("quality")
    for r in range(ROUNDS):
        model.learn(exchanged(pool, model.views, f"round {r} "))
    model.combine()
    return model


def applied(rows: DataFrame, model: Model | None, keep: list[str], views: Callable[[pa.StructArray], list[np.ndarray]]) -> DataFrame:
    """A struct row of the columns keep, and quality_score, content_margin, metadata_margin, accepted.

    rows: the struct row; views gives both views of a batch of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model and {**vars(model), "views": [vars(v) for v in model.views]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if shared.value:
            model = Model.__new__(Model)
            vars(model).update(shared.value)
            model.views = [View.__new__(View) for _ in shared.value["views"]]
            for view, state in zip(model.views, shared.value["views"]):
                vars(view).update(state)
        for part in slices(batches, 300):
            row, n = part.column("row"), part.num_rows
            m, s, good = np.zeros((n, 2)), np.ones(n), np.ones(n, dtype=bool)
            if model:
                x = views(row)
                m, s = model.margins(x), model.score(x)
                good = s >= model.threshold
            new = [pa.array(v) for v in (s.astype(float), m[:, 0].astype(float), m[:, 1].astype(float), good)]
            yield pa.RecordBatch.from_arrays([row, *new], ["row", "quality_score", "content_margin", "metadata_margin", "accepted"])

    kind = rows.schema["row"].dataType.simpleString()
    got = rows.mapInArrow(run, f"row {kind}, quality_score double, content_margin double, metadata_margin double, accepted boolean")
    return got.withColumn("row", F.struct(*(F.col("row")[c].alias(c) for c in keep)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality_score, content_margin, metadata_margin, accepted)."""
    rows = featured(docs)
    names = rows.columns

    def views(row: pa.StructArray) -> list[np.ndarray]:
        return unpacked(pa.RecordBatch.from_arrays([row.field(i) for i in range(len(names))], names))

    got = applied(rows.select(F.struct("*").alias("row")), fitted(rows, labels), ["doc_id"], views)
    return got.select("row.*", "quality_score", "content_margin", "metadata_margin", "accepted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts; the columns of docs."""
    rows = featured(docs)
    model = fitted(rows, labels)
    discard(rows)
    need = needed(docs, docs.columns)
    names = need.columns

    def views(row: pa.StructArray) -> list[np.ndarray]:
        return viewed(*(row.field(names.index(c)).to_pylist() for c in COLUMNS))

    return applied(need.select(F.struct("*").alias("row")), model, docs.columns, views).where("accepted").select("row.*")
