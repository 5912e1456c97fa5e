"""Quality scores by positive-unlabelled learning.

A linear model minimises the non-negative unbiased risk from trusted positives, unlabelled web text and
an estimated class prior.  Features are rates of characters, words and lines of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import id_remainder
from palimpsest.scratch import stored

#: Distinct positive texts that the model is fitted on, at most about, and half of the unlabelled ones; a documented bound.
SAMPLE = 12_000
#: Documents whose features are computed in one step.
ROWS = 2048
#: Features: shares of the 128 ASCII characters and of other bytes, then the figures of ``_shape``.
_SHAPES = 8
WIDTH = 129 + _SHAPES


def _shape(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Figures of words and lines of each document, each near 0 to 1."""
    n = len(ends) - 1
    words, at = buffers.word_hashes(raw, ends)
    count = np.diff(at)
    distinct, to = buffers.distinct_per_document(words, at)
    sizes = np.diff(ends)
    safe, size = np.maximum(count, 1), np.maximum(sizes, 1)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])[ends]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])[ends]
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[2:] = np.cumsum(words[1:] == words[:-1])
    repeats = np.maximum(0, same[np.minimum(at[1:], len(words))] - same[np.minimum(at[:-1] + 1, len(words))])
    marks = (raw >= 33) & (raw <= 126) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 65) & (raw <= 90)) & ~((raw >= 97) & (raw <= 122))
    marked = np.concatenate([[0], np.cumsum(marks)])[ends]
    alone = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 2:
        alone[2:-1] = np.cumsum(buffers.SPACE[raw[:-2]] & buffers.SPACE[raw[2:]] & ~buffers.SPACE[raw[1:-1]])
        alone[-1] = alone[-2]
    single = np.diff(alone[ends])
    out = np.zeros((n, _SHAPES), np.float32)
    out[:, 0] = np.log1p(count) / 10
    out[:, 1] = np.diff(to) / safe
    out[:, 2] = np.minimum(sizes / safe, 40) / 20
    out[:, 3] = np.diff(upper) / size
    out[:, 4] = np.diff(lines) / safe
    out[:, 5] = repeats / safe
    out[:, 6] = np.diff(marked) / safe
    out[:, 7] = single / safe
    return out


def features(texts: pa.Array):
    """Yield (first document, feature matrix) for runs of documents."""
    data, offsets = buffers.utf8(texts)
    for first, last in buffers.runs_of_documents(offsets, most=ROWS):
        part = offsets[first : last + 1]
        raw, ends = data[part[0] : part[-1]], part - part[0]
        n = len(ends) - 1
        cell = np.repeat(np.arange(n) * 129, np.diff(ends)) + np.minimum(raw, 128)
        rates = np.bincount(cell, minlength=n * 129).reshape(n, 129) / np.maximum(1, np.diff(ends))[:, None]
        yield first, np.hstack([np.log1p(300 * rates).astype(np.float32), _shape(raw, ends)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, penalty: float = 1e-3, plain: bool = False) -> Model:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss.

    When the bracket, the estimated risk on negatives, falls below zero the step goes against it, which
    keeps the model from fitting the positives as negatives.  ``plain`` minimises E_p[l(g)] + E_u[l(-g)] instead.
    """
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        loss = lambda g: np.logaddexp(0, -g)
        slope = lambda g: -1 / (1 + np.exp(np.clip(g, -30, 30)))
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        dn_p, dn_u = prior * slope(-gp) / len(p), -slope(-gu) / len(u)
        if plain:
            d_p, d_u = slope(gp) / len(p), dn_u
        elif negative >= 0:
            d_p, d_u = prior * slope(gp) / len(p) + dn_p, dn_u
        else:
            d_p, d_u = -dn_p, -dn_u
        grad = np.append(d_p @ p + d_u @ u + penalty * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate / (1 + k / 300) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, float(b), prior)


def fit_membership(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600) -> Model:
    """A logistic model of being among the positives rather than the unlabelled texts, both weighted alike."""
    return fit_nnpu(positive, unlabelled, 0.0, steps, plain=True)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, surety: float = 0.1) -> float:
    """The share of positives among the unlabelled texts, from the two samples alone (best bin estimation).

    Half of each sample trains a membership model, the other half is scored.  For any threshold, the share of
    unlabelled texts above it over that of positives bounds the prior from above; the threshold with the
    least bound, sampling error included, gives the estimate.  No negative's label is read.
    """
    p, u = positive[1::2], unlabelled[1::2]
    if not len(p) or not len(u):
        return 0.5
    model = fit_membership(positive[::2], unlabelled[::2])
    sp, su = np.sort(model.score(p)), np.sort(model.score(u))
    above_p = np.arange(len(sp), 0, -1) / len(sp)
    above_u = (len(su) - np.searchsorted(su, sp, "left")) / len(su)
    error = np.sqrt(np.log(4 / surety) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _drawn(docs: DataFrame, positives: DataFrame, n_positive: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of positives and of unlabelled texts: about ``sample`` and twice as many distinct texts, drawn by hash.

    Unlabelled texts are drawn from all of ``docs``, whatever is known of them.  Ids and text hashes alone meet
    the labels; of the texts only the drawn ones, a bounded number, are read.
    """
    keyed = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"))
    n = keyed.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    rate = F.when(F.col("_kind") == "p", min(1.0, sample / max(1, n_positive))).otherwise(min(1.0, 2 * sample / max(1, n)))
    # Two draws by different bits of the hash, so that neither sample shapes the other.
    at = F.when(F.col("_kind") == "p", F.pmod("h", F.lit(1 << 20))).otherwise(F.pmod(F.xxhash64("h"), F.lit(1 << 20)))
    rows = keyed.join(positives.withColumn("_good", F.lit(True)), "doc_id", "left").withColumn("_kind", F.explode(F.when(F.col("_good"), F.array(F.lit("p"), F.lit("u"))).otherwise(F.array(F.lit("u")))))
    chosen = stored(rows.where(at < rate * (1 << 20)).groupBy("h", "_kind").agg(F.min("doc_id").alias("doc_id")), "drawn")

    def run(batches):
        for batch in buffers.slices(batches):
            for first, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(x)), batch.column(2).slice(first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "kind", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("h"))
    got = texts.select("text", "h", "_kind").mapInArrow(run, "h long, kind string, x binary").dropDuplicates(["h", "kind"]).toArrow().sort_by("h")
    kinds = np.array(got["kind"].to_pylist(), object)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return x[kinds == "p"], x[kinds == "u"]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on trusted positives (quality 1) of ``labels`` against unlabelled texts of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; only rows to learn from may be given.  Of the
    labels only the positives are read; the class prior is estimated from the two samples.  Without a
    positive or an unlabelled text the model scores every text one half.
    """
    positives = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    positive, unlabelled = _drawn(docs, positives, positives.count(), sample)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5): every whole text, null as empty.

    Rows map one to one; other columns pass through; score and predicted of the input are replaced.
    """
    keep = docs.drop("score", "predicted")

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [model.score(x) for part in buffers.text_slices(texts) for _, x in features(part)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    scored = keep.withColumn("score", judge.asNondeterministic()("text"))  # only the text goes to Python, once
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted.  Labels and texts are learned only from rows that aren't held out.

    Equal texts get equal scores; a null text is scored as an empty one; repeated rows repeat.  A row is held out when crc32 of its id as text, modulo ``folds``, is ``held_out``; null ids are held out.
    """
    out = F.coalesce(id_remainder("doc_id", folds) == held_out, F.lit(True))
    model = train(docs.where(~out), labels.where(~out), sample)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
