"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled of good quality; the unlabelled set is web
text taken without regard to labels. Features describe a text's shape, in any language:
shares of character classes and of their transitions, word and line lengths, repeated
words and lines. The class prior is estimated from positives and unlabelled text alone:
over thresholds of a positive-against-unlabelled scorer, the least ratio of the shares
above (unlabelled to positive) with its confidence width. A one-layer network then
minimises prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior *
risk(positives as 0)); where that difference turns negative its ascent step is taken.

Only text enters a score. Characters are classed in parts of PART, so that a very long
text takes memory for its words only (some 100 bytes each). Defined results: null and empty texts have zero features and
are scored as such; repeated rows are each scored; with no positive every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.common import encoders_freed, fold, spread_sample

#: Trusted positives, and unlabelled documents, that the model is fitted on.
POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, BATCH, RATE, PENALTY = 24, 60, 500, 4e-3, 1e-4
CLASSES = 9
#: Characters of a text that are classed at once.
PART = 1 << 18


def _class_table() -> np.ndarray:
    """Class of each character below U+10000: 0 lower, 1 upper, 2 other letter or mark, 3 digit, 4 space, 5 line feed, 6 sentence mark, 7 bracket or quote, 8 other."""
    table = np.full(1 << 16, 8, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c == "\n":
            table[i] = 5
        elif c.isspace():
            table[i] = 4
        elif c.islower():
            table[i] = 0
        elif c.isupper():
            table[i] = 1
        elif c.isalpha() or 0x300 <= i < 0x370:
            table[i] = 2
        elif c.isdigit():
            table[i] = 3
        elif c in ".,;:!?'-":
            table[i] = 6
        elif c in "()[]\"“”«»‘’":
            table[i] = 7
    return table


_TABLE = _class_table()
N_FEATURES = CLASSES + CLASSES * CLASSES + 11


def features(text: str | None) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    n, classes, moves = len(text), np.zeros(CLASSES), np.zeros(CLASSES * CLASSES)
    for lo in range(0, n, PART):
        # with the character after the part, for the move to it
        code = np.frombuffer(text[lo : lo + PART + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _TABLE[np.minimum(code, 0xFFFF)].astype(np.int64)
        classes += np.bincount(kind[:PART], minlength=CLASSES)
        moves += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
    out[:CLASSES] = np.sqrt(classes / n)
    if n > 1:
        out[CLASSES : CLASSES + CLASSES**2] = np.sqrt(moves / (n - 1))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    if words:
        lens = np.fromiter(map(len, words), np.float64, len(words))
        distinct = len(set(words))
        twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
        # distinct words among so many: set against the root, which texts of all lengths follow about
        out[CLASSES + CLASSES**2 :] = (
            np.log1p(len(words)) / 10,
            lens.mean() / 10,
            lens.std() / 10,
            distinct / len(words),
            np.log1p(distinct) / np.log1p(len(words)),
            np.sqrt(twice),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))) / 5,
            (lens == 1).mean(),
            (lens > 15).mean(),
            len(set(text)) / (20 + np.sqrt(n)),
        )
    return out


def _stack(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(-1, N_FEATURES)


class Network:
    """Standardised inputs, one hidden layer, one output; a model without a fit answers 0.5."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.params = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.steps = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def out(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.params[0] + self.params[1])
        return hidden @ self.params[2] + self.params[3][0], hidden

    def step(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray, rate: float = RATE) -> None:
        """One Adam step along the gradient whose derivative by the outputs is slope."""
        inner = np.outer(slope, self.params[2]) * (1 - hidden**2)
        grads = [x.T @ inner + PENALTY * self.params[0], inner.sum(0), hidden.T @ slope + PENALTY * self.params[2], np.array([slope.sum()])]
        self.steps += 1
        for p, g, (m, v) in zip(self.params, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.out(self.inputs(x))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the unlabelled scores u, from positives' scores p: the least ratio of the shares above a threshold, with its confidence width."""
    at = np.sort(np.unique(np.concatenate([p, u])))[:-1]
    share_p = 1 - np.searchsorted(np.sort(p), at, side="right") / len(p)
    share_u = 1 - np.searchsorted(np.sort(u), at, side="right") / len(u)
    ok = share_p > 0.05
    if not ok.any():
        return 0.5
    share_p, share_u = share_p[ok], share_u[ok]
    width = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    best = np.argmin((share_u + width) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def _fitted(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int) -> Network:
    """With a prior: the non-negative risk; without: plain positive-against-unlabelled scores, both sets of equal weight."""
    both = np.concatenate([p, u])
    net = Network(both.mean(0), both.std(0) + 1e-3, seed)
    p, u, rng = net.inputs(p), net.inputs(u), np.random.default_rng(seed)
    for _ in range(EPOCHS if prior else EPOCHS // 4):
        order_u = rng.permutation(len(u))
        for lo in range(0, len(u), BATCH):
            xu = u[order_u[lo : lo + BATCH]]
            xp = p[rng.integers(0, len(p), min(len(p), max(1, len(xu) // 2)))]
            x = np.concatenate([xp, xu])
            z, hidden = net.out(x)
            s = _sigmoid(z)
            sp, su = s[: len(xp)], s[len(xp) :]
            if prior is None:
                slope = np.concatenate([(sp - 1) / len(xp), su / len(xu)])
            else:
                # logistic loss: as 0 it is log(1 + e^z)
                negative = np.logaddexp(0, z[len(xp) :]).mean() - prior * np.logaddexp(0, z[: len(xp)]).mean()
                if negative >= 0:
                    slope = np.concatenate([prior * (sp - 1) / len(xp) - prior * sp / len(xp), su / len(xu)])
                else:
                    slope = -np.concatenate([-prior * sp / len(xp), su / len(xu)])
            net.step(x, hidden, slope)
    return net


def fit(p: np.ndarray, u: np.ndarray) -> tuple[Network | None, float]:
    """(network, estimated class prior); no network without positives or unlabelled text."""
    if len(p) < 2 or len(u) < 2:
        return None, 0.5
    half = _fitted(p[::2], u[::2], None, 1)
    prior = class_prior(half.score(p[1::2]), half.score(u[1::2]))
    return _fitted(p, u, prior, 2), prior


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network | None, float]:
    """Fits on bounded samples; features are taken on the executors. No label of the held-out fold, and no label 0, is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.tobytes() for x in _stack(t.as_py() for t in batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["trusted", "found"])

    good = labels.filter((F.col("quality") == 1) & (fold("doc_id", 5) != 0)).select("doc_id").distinct()
    chosen = spread_sample(good, "doc_id", positives).withColumn("trusted", F.lit(True))
    web = spread_sample(docs.select("doc_id").distinct(), "doc_id", unlabelled).withColumn("trusted", F.lit(False))
    both = chosen.unionByName(web)  # of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("trusted", "text").mapInArrow(run, "trusted boolean, found binary").collect()
    sets = [np.array([np.frombuffer(r.found, np.float32) for r in rows if r.trusted is t]).reshape(-1, N_FEATURES) for t in (True, False)]
    return fit(*(x[np.lexsort(x.T)] for x in sets))


def score(docs: DataFrame, network: Network | None, into: str = "score") -> DataFrame:
    """Every row of docs with column ``into`` (0 to 1), in place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders_freed()
        own = shared.value
        for texts in batches:
            found = np.full(len(texts), 0.5) if own is None or not len(texts) else own.score(_stack(t.as_py() for t in texts))
            yield pa.array(found, pa.float64())

    return docs.withColumn(into, run("text"))


def quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, into: str = "score") -> DataFrame:
    """Trains on labels.quality = 1 outside the held-out fold and unlabelled text, and scores all docs: their columns and ``into``."""
    return score(docs, train(docs, labels, positives, unlabelled)[0], into)
