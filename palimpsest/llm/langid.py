"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become hashed byte-trigram profiles.  Linear support vector machines are fitted on a bounded
sample of labelled rows; every whole text is then scored inside Spark tasks.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import id_remainder, unused
from palimpsest.scratch import free_driver

#: Families of language codes.  Fixed values; a code that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
#: Cells of a hashed profile.
CELLS = 4096
#: Documents profiled in one step, so that memory doesn't follow the number of short texts in a batch.
ROWS = 256
#: Distinct texts of each language that the machines are fitted on, at most; a documented bound.
SAMPLE = 800
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def profiles(texts: pa.Array):
    """Yield (first document, profile matrix, whether each has a letter) for runs of at most ROWS documents."""
    data, offsets = buffers.utf8(texts)
    for first, last in buffers.runs_of_documents(offsets, most=ROWS):
        part = offsets[first : last + 1]
        raw, ends = data[part[0] : part[-1]], part - part[0]
        n = len(ends) - 1
        sums = np.zeros((n, CELLS), np.float32)
        if len(raw) > 2:
            low = buffers._LOWER[raw].astype(np.uint32)
            code = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
            inside = doc[:-2] == doc[2:]
            sums += np.bincount(doc[:-2][inside] * np.int64(CELLS) + code[inside], minlength=n * CELLS).reshape(n, CELLS)
        np.sqrt(sums, out=sums)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        sums /= np.where(norm == 0, 1, norm)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])[ends]
        has = np.diff(letters) > 0
        for k in np.flatnonzero(~has & (np.diff(ends) > 0)):
            has[k] = _LETTER.search(bytes(raw[ends[k] : ends[k + 1]]).decode("utf-8")) is not None
        yield first, sums, has


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, classes weighted alike) by accelerated descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * 2.0 + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = (ahead - step * (penalty * ahead - 2 * (share * y * slack).astype(np.float32) @ x)).astype(np.float32)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Duels:
    """One-versus-one machines over some classes; the most duels won decides, then the summed margin."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((CELLS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        classes = sorted(set(labels))
        found = []
        for a, b in itertools.combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            found.append(fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        if not found:
            return cls(classes)
        return cls(classes, np.stack([w for w, _ in found], axis=1), np.array([b for _, b in found]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, smallest margin with which the winner won or lost a duel; infinite without duels)."""
        margins = x @ self.weights + self.biases
        won, total = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(itertools.combinations(range(len(self.classes)), 2)):
            won[:, a] += margins[:, k] >= 0
            won[:, b] += margins[:, k] < 0
            total[:, a] += margins[:, k]
            total[:, b] -= margins[:, k]
        best = (won + 1e-3 * np.tanh(total)).argmax(axis=1)
        least = np.full(len(x), np.inf)
        for k, (a, b) in enumerate(itertools.combinations(range(len(self.classes)), 2)):
            least = np.where(best == a, np.minimum(least, margins[:, k]), np.where(best == b, np.minimum(least, -margins[:, k]), least))
        return best, least


@dataclass
class Model:
    """Machines between families, and between the languages of each family."""

    families: Duels
    inside: dict[str, Duels]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.families.classes:
            return np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        family, least = self.families.predict(x)
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, margin = self.inside[name].predict(x[rows])
                out[rows] = np.array(self.inside[name].classes, object)[best]
                least[rows] = np.minimum(least[rows], margin)
        return out, 1 / (1 + np.exp(-4 * np.clip(least, -20, 20)))


def train(labelled: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Model:
    """Fit on at most about ``sample`` distinct texts of each language of ``labelled`` (text, lang).

    Rows with a null text or lang are left out.  Texts are drawn by a hash of the text, at a rate from
    each language's count of distinct texts, so copies count once and a hot source has no more weight.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model(Duels([]), {})
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, sample / max(1, n)))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "h"])

    def run(batches):
        for batch in buffers.slices(batches):
            for first, x, _ in profiles(batch.column(1)):
                flat = [row.astype(np.float16).tobytes() for row in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), batch.column(2).slice(first, len(x)), pa.array(flat, pa.binary())], names=["lang", "h", "x"])

    got = drawn.select("lang", "text", "h").mapInArrow(buffers.tidy(run), "lang string, h long, x binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    labels = np.array(got["lang"].to_pylist(), object)
    kept = np.concatenate([np.flatnonzero(labels == a)[: 2 * sample] for a in sorted(set(labels))])
    raw = got["x"].take(pa.array(kept)).combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    x = np.frombuffer(raw.buffers()[2], np.float16)[: len(kept) * CELLS].reshape(-1, CELLS).astype(np.float32)
    labels = labels[kept]
    del got, raw
    kin = np.array([families.get(a, a) for a in labels], object)
    model = Model(Duels.fit(x, kin), {k: Duels.fit(x[kin == k], labels[kin == k]) for k in sorted(set(kin))})
    del x
    buffers.release()
    free_driver(labelled.sparkSession)
    return model


def _judged(texts: pa.Array, model: Model) -> tuple[pa.Array, pa.Array]:
    """(lang_pred, score) of each text."""
    lang, score = [], []
    for part in buffers.text_slices(texts):
        for _, x, has in profiles(part):
            best, sure = model.predict(x)
            lang.append(np.where(has, best, UNKNOWN))
            score.append(np.where(has, sure, 0.0))
    flat = np.concatenate(lang).tolist() if lang else []
    return pa.array(flat, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())


def language_of(model: Model):
    """A column function of a text column that gives struct(lang_pred, score), see ``predict``; only the text goes to Python."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_judged(texts, model), names=["lang_pred", "score"])

    return judge.asNondeterministic()  # never evaluated twice for a filter and a result


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1): the language of each whole text.

    A null text, or one without a letter, is ``und`` with score 0; without any learned language all rows
    are.  Rows map one to one; other columns pass through; lang_pred and score of the input are replaced.
    """
    keep = docs.drop("lang_pred", "score")
    told = unused(keep, "_told")
    return keep.withColumn(told, language_of(model)("text")).select(*keep.columns, f"{told}.lang_pred", f"{told}.score")


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, predicted for all.

    A row is held out when crc32 of its id as text, modulo ``folds``, is ``held_out``; one with a null id is
    held out as well.  Other columns are left out; a null text or one without a letter is ``und``.
    """
    out = F.coalesce(id_remainder("doc_id", folds) == held_out, F.lit(True))
    model = train(docs.where(~out).select("text", "lang"), sample)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
