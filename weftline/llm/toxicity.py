"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed 3- to 6-character n-grams of the lower-cased text,
white space runs as one space. Over the labelled sample, r = log of the ratio of a
feature's smoothed share among toxic and among other documents; a logistic regression
on the features times r, where r is significant, gives the weights, drawn towards their common mean as in
interpolated NB-SVM. Both classes are sampled to one bound, and the intercept is set
back to the classes' true shares.

Features are counted on the executors; the driver holds those that are significant, at
most one a bucket, and which of them each sampled document has. Texts are read in parts
of PART characters, so that a very long one takes little more than its own size.

Only text enters a score. Defined results: null and empty texts have no feature and get
the intercept's score; repeated rows are each scored; with no labelled row of either
class every score is the share of toxic rows (0.5 with no labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.common import encoders_freed, fold, forget, passes, spread_sample, written

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
#: Labelled rows of either class that the model is fitted on.
SAMPLE = 1500
#: Documents a feature needs in the sample, and the least |r| that is kept, in standard errors of r.
LEAST_DOCS, LEAST_ERRORS = 4, 3.0
SMOOTHING, INTERPOLATION, PENALTY, STEPS = 0.5, 0.1, 0.2, 400
#: Characters that n-grams are taken from at once, and pairs of document and feature that the fit looks at at once.
PART, PAIRS = 1 << 18, 1 << 19
_SPACES = re.compile(r"\s+")
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str | None) -> str:
    return " " + _SPACES.sub(" ", (text or "").lower()).strip() + " "


def buckets(text: str | None) -> np.ndarray:
    """The distinct hash buckets of the text's n-grams, ascending."""
    text = _plain(text)
    if len(text) <= PART:
        return np.unique(_ngrams(text))
    seen = np.zeros(1 << BUCKET_BITS, bool)
    for lo in range(0, len(text), PART):
        # an n-gram belongs to the part that it begins in
        seen[_ngrams(text[lo : lo + PART + max(ORDERS) - 1])] = True
    return np.flatnonzero(seen)


def _ngrams(text: str) -> np.ndarray:
    """Hash bucket of every n-gram, repeats included."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < 3:
        return np.empty(0, np.int64)
    rolled, out = code, []
    for n in range(2, max(ORDERS) + 1):
        if n > len(code):
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in ORDERS:
            out.append(((rolled ^ np.uint64(n)) * _HASH >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text): at most ``bound`` rows of either label outside the held-out fold, chosen by hash of their ids."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", 5) != 0)).distinct()
    chosen = spread_sample(known, "doc_id", bound, by="label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice the bound


class Model:
    """Weights by bucket and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, text: str | None) -> float:
        text, seen = _plain(text), []
        for lo in range(0, len(text), PART):
            found = _ngrams(text[lo : lo + PART + max(ORDERS) - 1])
            seen.append(np.unique(found[self.weights[found] != 0]))
        found = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
        return float(1 / (1 + np.exp(-(self.intercept + float(self.weights[found].sum(dtype=np.float64))))))


def fit(sets: list[np.ndarray], labels: list[int], kept: np.ndarray, ratio: np.ndarray, toxic_share: float) -> Model:
    """Model of documents, each given by the numbers of the kept buckets that it has, the buckets' log-count ratios and the labels."""
    y = np.array(labels, np.float64)
    prior = np.log(toxic_share / (1 - toxic_share))
    weights = np.zeros(1 << BUCKET_BITS)
    if not 0 < y.sum() < len(y) or not len(ratio):
        return Model(weights, prior)
    sizes = np.array([len(s) for s in sets])
    parts = []
    for lo, hi in passes(sizes.tolist(), PAIRS):
        owner = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])
        parts.append((lo, hi, owner, np.concatenate([np.empty(0, np.int32), *sets[lo:hi]])))
    w, b = np.full(len(ratio), 0.02), 0.0
    first, second, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        grad, g_b, scaled = PENALTY * w / len(w), 0.0, w * ratio
        for lo, hi, owner, index in parts:
            z = np.bincount(owner, weights=scaled[index], minlength=hi - lo) + b
            gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[lo:hi]) / len(y)
            grad += np.bincount(index, weights=gap[owner], minlength=len(w)) * ratio
            g_b += gap.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b**2
        rate = 0.02 / (1 - 0.9**step)
        w -= rate * first / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        b -= rate * m_b / (np.sqrt(v_b / (1 - 0.99**step)) + 1e-8)
    w = (1 - INTERPOLATION) * w + INTERPOLATION * np.abs(w).mean()
    weights[kept] = w * ratio
    return Model(weights, b + prior - np.log(y.mean() / (1 - y.mean())))


def ratios(counted: DataFrame, n: int, toxic: int) -> DataFrame:
    """(bucket, ratio) of the significant features of counted(bucket, docs, toxic), over n documents of which ``toxic`` are toxic."""
    p, q = F.col("toxic") + SMOOTHING, F.col("docs") - F.col("toxic") + SMOOTHING
    told = counted.select("bucket", "docs", F.sqrt(1 / p + 1 / q).alias("error"), (F.log(p / (toxic + 2 * SMOOTHING)) - F.log(q / (n - toxic + 2 * SMOOTHING))).alias("ratio"))
    return told.filter((F.col("docs") >= LEAST_DOCS) & (F.abs("ratio") >= LEAST_ERRORS * F.col("error"))).select("bucket", "ratio")


def _sets_of(texts: DataFrame) -> DataFrame:
    """(label, found): the distinct buckets of texts(label, text), as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [buckets(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "found"])

    return texts.select("label", "text").mapInArrow(run, "label int, found binary")


def _counted(sets: DataFrame) -> DataFrame:
    """(bucket, docs, toxic): the documents, and the toxic ones, that have a bucket; counted in each task before rows move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, toxic = np.zeros(1 << BUCKET_BITS, np.int32), np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(found.as_buffer(), "<i4")
                docs[found] += 1  # a set holds a bucket once
                toxic[found] += label
        some = np.flatnonzero(docs)
        for at in np.array_split(some, len(some) // 10_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), docs[at].astype(np.int64), toxic[at].astype(np.int64))], names=["bucket", "docs", "toxic"])

    return sets.mapInArrow(run, "bucket int, docs long, toxic long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Fits on the bounded sample; no text and no feature that is not significant reaches the driver."""
    train_rows = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0))
    n, toxic = train_rows.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = min(max((toxic + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    sets = written(_sets_of(labelled_sample(docs, labels, "toxic", bound)), "toxicity-sets")
    seen, seen_toxic = sets.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    kept = ratios(_counted(sets), seen, seen_toxic).toPandas().sort_values("bucket")  # at most a row a bucket
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[kept["bucket"].to_numpy()] = np.arange(len(kept), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(number)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [shared.value[np.frombuffer(x.as_buffer(), "<i4")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0].tobytes() for x in known], pa.binary())], names=["label", "found"])

    rows = sets.mapInArrow(run, "label int, found binary").toPandas()
    rows = rows.sort_values(["label", "found"])  # the same model whatever the order of tasks
    forget(sets)
    return fit([np.frombuffer(x, np.int32) for x in rows["found"]], rows["label"].tolist(), kept["bucket"].to_numpy(), kept["ratio"].to_numpy(), share)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Every row of docs with column ``into`` (0 to 1), in place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: a weight a bucket

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders_freed()
        own = shared.value
        for texts in batches:
            yield pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(into, run("text"))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, into: str = "score") -> DataFrame:
    """Trains on labels.toxic outside the held-out fold and scores all docs: their columns and ``into``."""
    return score(docs, train(docs, labels, bound), into)
