"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 2- to 4-character n-grams of its lower-cased letters, each
run of other characters standing as one space; a text is the mean of its subwords'
embeddings, and a linear softmax gives the languages' shares. Training is stochastic
gradient descent in numpy on whole texts and short snippets of a sample bounded for
each language. On a calibration part of the sample, a temperature is fitted to the
scores and the threshold below which a prediction is flagged as rejected is set so that
a stated share of right predictions passes.

Only text enters a prediction. Defined results: ``und`` with score 0 if the text is null
or has no letter, or nothing could be learned; repeated rows are each predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.common import fold, free_name, spread_sample

ORDERS = (2, 3, 4)
BUCKET_BITS, WIDTH = 16, 16
#: Documents of each language that the model is fitted on.
SAMPLE = 800
EPOCHS, RATE = 6, 0.25
#: Share of right predictions on the calibration part that must not be rejected.
KEPT = 0.99
#: Longest texts in characters are read in parts of this size, so that memory stays bounded.
PART = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")
_HASH = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """Hash bucket of every subword of the text; empty where it has no letter."""
    text = _OTHER.sub(" ", text.lower()).strip()
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rolled, out = code, []
    for n in range(2, max(ORDERS) + 1):
        if n > len(code):
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in ORDERS:
            out.append(((rolled ^ np.uint64(n)) * _HASH >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Languages, and for each bucket the languages' scores (its embedding times the softmax's weights)."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.languages, self.table, self.bias = languages, table.astype(np.float32), bias
        self.temperature, self.least = temperature, least

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for lo in range(0, len(text), PART):
            found = buckets(text[lo : lo + PART])
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(found: list[np.ndarray], counts: list[np.ndarray], langs: list[str], calibrate: list[bool], seed: int = 3) -> Model:
    """found and counts: each example's distinct buckets and how often each occurs."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    rows = np.flatnonzero([not c and len(f) > 0 for c, f in zip(calibrate, found, strict=True)])
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(rows):
            f, w = found[i], (counts[i] / counts[i].sum()).astype(np.float32)
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = w @ embed[f]
            gap = softmax(hidden @ out + bias)
            gap[y[i]] -= 1
            back = out @ gap
            out -= rate * np.outer(hidden, gap)
            bias -= 0.01 * rate * gap
            # every subword moves by the gradient of the mean, scaled as if it stood alone
            embed[f] -= rate * np.outer(w * np.float32(min(len(f), 50)), back)
    model = Model(languages, embed @ out, bias.astype(np.float64))
    held = [i for i, c in enumerate(calibrate) if c and len(found[i])]
    if held:
        z = np.stack([(model.table[found[i]] * counts[i][:, None]).sum(0) / counts[i].sum() + bias for i in held]).astype(np.float64)
        target = y[held]
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), target] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == target]
        model.least = float(np.quantile(right, 1 - KEPT)) if len(right) else 0.0
    return model


def _examples(text: str, key: int) -> Iterator[np.ndarray]:
    """The whole text's buckets, then those of two snippets."""
    yield np.concatenate([buckets(text[lo : lo + PART]) for lo in range(0, max(1, len(text)), PART)])
    rng = np.random.default_rng(key & 0xFFFFFFFF)
    for size in (30, 100):
        if len(text) > 2 * size:
            at = int(rng.integers(0, len(text) - size))
            yield buckets(text[at : at + size])


def train(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """Fits on at most ``bound`` documents of each language outside the held-out fold; subwords are counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for e in _examples(text, doc_id or 0):
                    f, c = np.unique(e, return_counts=True)
                    rows.append((lang, (doc_id or 0) % 5 == 0, f.astype("<u4").tobytes(), c.astype("<u4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["lang", "calibrate", "found", "counts"])

    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    chosen = spread_sample(usable.select("doc_id", "lang"), "doc_id", bound, by="lang").distinct()
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most the bound for each language
    rows = texts.mapInArrow(run, "lang string, calibrate boolean, found binary, counts binary").collect()
    rows.sort(key=lambda r: (r.lang, r.found))
    found, counts = ([np.frombuffer(r[k], "<u4").astype(np.int64) for r in rows] for k in (2, 3))
    return fit(found, counts, [r.lang for r in rows], [r.calibrate for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with lang_pred, score and rejected in place of columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for a language

    @arrow_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            told = list(zip(*(own.predict(t.as_py()) for t in texts), strict=True)) or [[]] * 3
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(told, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["lang_pred", "score", "rejected"])

    told = free_name(docs, "told")
    out = docs.withColumn(told, run("text"))
    return out.withColumns({k: F.col(told)[k] for k in ("lang_pred", "score", "rejected")}).drop(told)


def identify(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Trains on docs' own non-null languages outside the held-out fold and predicts all docs."""
    return predict(docs, train(docs, bound))
