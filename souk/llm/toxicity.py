"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words (A-Z in lower case, punctuation at their ends
dropped) and the first ``stem`` code points of longer words, each hashed to
one of ``buckets`` places. With x one at the text's distinct terms, the score is the
logistic function of

    b + sum w_i + 1/2 * sum_f ((sum v_if)^2 - sum v_if^2)

so pairs of terms that only together make a text toxic (an insult beside a
group's name) get weight of their own, which additive weights miss. Nothing is
divided by the number of terms: a pair weighs the same in a text of 2,000 words as
in one of ten. So that the very many pairs of a long text don't drown the telling
ones, factors belong to terms with evidence in the training rows, of two kinds:

* terms with an additive weight in both halves of the rows, each half fitted apart;
  their factors learn at ``shared_rate``;
* terms of a pair whose sum of residuals (of the other half's additive weights) over
  the texts with both is beyond the L1 term and beyond ``deviations`` standard deviations,
  whatever their own weights; these learn at ``pair_rate``. All pairs of terms whose own
  residuals allow that are looked at.

The factors of all others are zero.

Training: one task fits the machine by Adam on at most ``max_rows`` labelled
rows and ``max_chars`` code points of them in all, the first in the order of
a hash of the id, so the fit's memory and time are bounded whatever the
corpus; rows whose id's CRC-32 is divisible by ``folds`` are never among them.
Labels are the only thing besides texts that the fit sees. Scoring is a map
over all whole texts with the model (a fixed size: buckets * (rank + 1)
floats) as a broadcast.

Defined results: a null or empty text scores what the bias alone gives; rows
that repeat score alike; a null id is never in the held-out part and never
labelled; labels that repeat or conflict count by their maximum; null labels
are no labels; with no labelled row at all every score is 0.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import raw

BUCKETS = 1 << 17
RANK = 4
STEM = 4
FOLDS = 5
MAX_ROWS = 12_000
MAX_CHARS = 48_000_000
EPOCHS = 6
_EDGES = string.punctuation.encode()


def terms(text: bytes, buckets: int, stem: int) -> np.ndarray:
    """Distinct places of a text's terms."""
    words = {w.strip(_EDGES) for w in text.lower().split()}
    words.discard(b"")
    found = set()
    for word in words:
        found.add(zlib.crc32(word) % buckets)
        if len(word) > stem:
            head = word[: 4 * stem].decode("utf-8", "ignore")[:stem]
            found.add(zlib.crc32(b"\0" + head.encode()) % buckets)
    return np.fromiter(found, np.int32, len(found))


class Machine:
    """Weights of a trained machine; arrays of a fixed size."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, stem: int):
        self.bias, self.w, self.v, self.stem = bias, w, v, stem

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.v[at]
        total = v.sum(0)
        pairs = 0.5 * float(total @ total - (v * v).sum())
        return self.bias + float(self.w[at].sum()) + pairs

    def score(self, text: bytes) -> float:
        m = self.margin(terms(text, len(self.w), self.stem))
        return float(1 / (1 + np.exp(-np.clip(m, -60, 60))))


def telling(x: list[np.ndarray], r: np.ndarray, buckets: int, least: float, deviations: float, block=512):
    """Places of the terms that are in a pair with evidence, by the residuals ``r`` of the
    rows: the sum over the rows with both is beyond ``least`` and ``deviations``."""
    row = np.repeat(np.arange(len(x), dtype=np.int32), [len(a) for a in x])
    place = np.concatenate([*x, np.zeros(0, np.int32)])
    sums = lambda part: np.bincount(place, part[row], buckets)
    # no pair's sum is beyond what either term's residuals of one sign add up to
    most = np.maximum(sums(np.maximum(r, 0)), sums(np.maximum(-r, 0)))
    spread = np.sqrt(sums(r * r))
    able = np.flatnonzero(most > least)
    number = np.full(buckets, -1)
    number[able] = np.arange(len(able))
    at = number[place]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]

    def dense(start):
        lo, hi = np.searchsorted(at, [start, start + block])
        out = np.zeros((len(x), min(block, len(able) - start)), np.float32)
        out[row[lo:hi], at[lo:hi] - start] = 1
        return out

    found = np.zeros(len(able), bool)
    for i in range(0, len(able), block):
        left = (dense(i) * r[:, None].astype(np.float32)).T
        a = spread[able[i : i + block], None]
        for j in range(i, len(able), block):
            both = np.abs(left @ dense(j))
            if i == j:
                np.fill_diagonal(both, 0)
            passed = both > np.maximum(least, deviations * np.minimum(a, spread[able[None, j : j + block]]))
            found[i : i + block] |= passed.any(1)
            found[j : j + block] |= passed.any(0)
    return able[found]


def fit(
    texts: list[bytes], labels, buckets=BUCKETS, rank=RANK, stem=STEM, epochs=EPOCHS, seed=7,
    alpha=1.0, l1=6.0, l2=0.1, pair_rate=0.05, shared_rate=0.005, pair_l2=0.01, deviations=6.0,
) -> Machine:
    """Additive weights by follow-the-regularised-leader with an L1 term, which
    keeps the many terms without evidence at zero; pair factors by AdaGrad. The residuals
    that tell which terms have factors come from additive weights of the other half
    of the rows, so that weights that fit their own rows don't hide a pair."""
    rng = np.random.default_rng(seed)
    x = [terms(t, buckets, stem) for t in texts]
    y = np.asarray(labels, np.float64)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    logistic = lambda m: 1 / (1 + np.exp(-np.clip(m, -60, 60)))

    def learn(rows, has, rate):
        bias, z, n, w = start, np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
        v, gv = np.zeros((buckets, rank)), np.zeros((buckets, rank))
        v[has] = rng.normal(0, 0.05, (int(has.sum()), rank))
        paired = {k: x[k][has[x[k]]] for k in rows}
        for _ in range(epochs):
            for k in rng.permutation(rows):
                at, two = x[k], paired[k]
                if not len(at):
                    continue
                m = bias + w[at].sum()
                if len(two) > 1:
                    va = v[two]
                    total = va.sum(0)
                    m += 0.5 * (total @ total - (va * va).sum())
                g = logistic(m) - y[k]
                bias -= 0.002 * g
                if abs(g) < 1e-3:
                    continue
                before = n[at]
                after = before + g * g
                z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w[at]
                n[at] = after
                za = z[at]
                w[at] = np.where(
                    np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((1 + np.sqrt(after)) / alpha + l2)
                )
                if len(two) > 1:
                    dv = g * (total - va) + pair_l2 * va
                    gv[two] += dv * dv
                    v[two] = va - rate[two, None] * dv / np.sqrt(gv[two] + 1e-8)
        return bias, w, v

    nothing, order = np.zeros(buckets, bool), rng.permutation(len(x))
    r, has = np.zeros(len(x)), ~nothing
    for half, other in ((order[::2], order[1::2]), (order[1::2], order[::2])):
        bias, w, _ = learn(half, nothing, None)
        r[other] = [y[k] - logistic(bias + w[x[k]].sum()) for k in other]
        has &= w != 0
    rate = np.full(buckets, shared_rate)
    told = telling(x, r, buckets, l1, deviations)
    has[told], rate[told] = True, pair_rate
    bias, w, v = learn(np.arange(len(x)), has, rate)
    return Machine(bias, w.astype(np.float32), v.astype(np.float32), stem)


def held_out(id_col, folds: int = FOLDS):
    """Null-safe: CRC-32 of the id as text is divisible by ``folds``."""
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(remainder == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
           max_rows: int, max_chars: int, folds: int) -> list:
    """At most ``max_rows`` (text, label), the first by a hash of the id."""
    marked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .filter(~held_out("_id", folds))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(F.broadcast(marked), "_id").filter(F.col("_text").isNotNull())


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = FOLDS,
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
    **options,
) -> Machine | None:
    """The machine fitted on a bounded sample; None without labelled rows."""
    rows = sample(docs, labels, id_col, text_col, label_col, max_rows, max_chars, folds)
    limit = max_chars

    def run(batches):
        texts, marks, left = [], [], limit
        for batch in batches:
            for text, label in zip(raw(batch.column("_text")), batch.column("_label").to_pylist()):
                if len(text) <= left:
                    left -= len(text)
                    texts.append(text)
                    marks.append(label)
        if texts:
            m = fit(texts, marks, **options)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.bias]), *(pa.array([a.tobytes()]) for a in (m.w, m.v))],
                names=["bias", "w", "v"],
            )

    fitted = (  # one task: the sample is bounded
        rows.repartitionByRange(1, "_order", "_id", F.xxhash64("_text"))
        .sortWithinPartitions("_order", "_id", F.xxhash64("_text"))
        .select("_text", "_label")
        .mapInArrow(run, "bias double, w binary, v binary")
        .first()
    )
    if fitted is None:
        return None
    w = np.frombuffer(fitted["w"], np.float32)
    v = np.frombuffer(fitted["v"], np.float32).reshape(len(w), -1)
    return Machine(fitted["bias"], w, v, options.get("stem", STEM))


def scorer(spark, machine: Machine | None):
    """A function that gives the score of a text column; only texts go to Python."""
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model, scores = shared.value, []
        for at in range(0, len(texts), 256):  # a batch may hold many long texts
            scores += [model.score(t) if model else 0.0 for t in raw(texts.slice(at, 256))]
        return pa.array(scores, pa.float64())

    return lambda text: run(text.cast("string"))


def score(
    docs: DataFrame,
    machine: Machine | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
    folds: int = FOLDS,
) -> DataFrame:
    """(id, held_out, score, predicted[, carry]) for every row."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        *([F.col(carry).alias("_carry")] if carry else []),
    )
    keep = [c for c in rows.columns if c != "_text"]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(t) if model else 0.0 for t in raw(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(scores, pa.float64())],
                names=[*keep, "score"],
            )

    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema).select(
        F.col("_id").alias(id_col),
        held_out("_id", folds).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        *([F.col("_carry").alias(carry)] if carry else []),
    )
