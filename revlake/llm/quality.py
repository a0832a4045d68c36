"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class a mean, a prior and a covariance, shrunk towards the pooled diagonal; a score is the logistic of the difference of
the two Gaussian log densities, whose Mahalanobis distances use Cholesky factors computed once per model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget

FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "line_break", "comma_stop", "distinct", "repeat", "space", "sentence"]
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, QUOTE, SYMBOL = range(8)


def character_classes() -> np.ndarray:
    """Class of each code point below 65,536; higher ones count as the last."""
    out = np.full(65536, SYMBOL, np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            out[cp] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            out[cp] = DIGIT
        elif c.isspace():
            out[cp] = SPACE
    for c in ",.;:?!":
        out[ord(c)] = STOP
    for c in "'\"-()":
        out[ord(c)] = QUOTE
    out[10] = LINE
    return out


def statistics(text: str, classes: np.ndarray) -> list[float]:
    """Transformed statistics of a whole text; a text without characters has a fixed vector."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(classes[np.minimum(cp, 65535)], minlength=8).tolist()
    tokens = text.split()
    words, chars = len(tokens), max(len(cp), 1)
    letters = max(n[LOWER] + n[UPPER], 1)
    share = lambda x, of: float(np.log((x + 0.5) / (of + 50.0)))
    repeats = sum(map(str.__eq__, tokens, tokens[1:]))
    marks = text.count("!")
    return [
        float(np.log1p(words)),
        float(np.log1p(letters / max(words, 1))),
        share(n[UPPER], letters),
        share(n[DIGIT], chars),
        share(n[SYMBOL] + marks, chars),
        share(n[LINE], words),
        float(np.log1p(n[STOP] / max(words, 1))),
        float(np.log((len(set(tokens)) + 2.0) / (words + 2.0)) + 0.25 * np.log1p(words / 100.0)),
        share(repeats, words),
        share(n[SPACE], chars),
        float(np.log((text.count(".") + 1.0) / (words + 10.0))),
    ]


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Cached model: per class the mean, inverse Cholesky factor, and log prior minus half the log determinant."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    offsets: tuple[float, float]

    @staticmethod
    def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrinkage: float) -> QuadraticDiscriminant:
        """From each class's row count, feature sums and sums of products; a missing class makes every score its prior."""
        d = total.shape[1]
        if count.min() <= 0:
            prior = float((count[1] + 1) / (count.sum() + 2))
            return QuadraticDiscriminant(None, None, (float(np.log(1 - prior)), float(np.log(prior))))
        means = total / count[:, None]
        covariance = square / count[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.tensordot(count / count.sum(), covariance, 1)
        target = np.diag(np.maximum(np.diag(pooled), 1e-4))
        factors, offsets = [], []
        for k in (0, 1):
            weight = shrinkage + (1 - shrinkage) * d / (d + count[k])
            lower = np.linalg.cholesky((1 - weight) * covariance[k] + weight * target + 1e-6 * np.eye(d))
            factors.append(np.linalg.inv(lower))
            offsets.append(float(np.log(count[k] / count.sum()) - np.log(np.diag(lower)).sum()))
        return QuadraticDiscriminant((means[0], means[1]), (factors[0], factors[1]), (offsets[0], offsets[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of features."""
        if self.means is None:
            log_odds = np.full(len(x), self.offsets[1] - self.offsets[0])
        else:
            density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
            log_odds = density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(log_odds, -60, 60)))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id with the statistics of each text as columns f0, f1, ..."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        forget()
        classes = character_classes()
        for batch in batches:
            x = np.array([statistics(t or "", classes) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *(f"f{i}" for i in range(len(FEATURES)))])

    ddl = f"doc_id {id_type}, " + ", ".join(f"f{i} double" for i in range(len(FEATURES)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, ddl)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_mod: int = 4, held_out_remainder: int = 2, shrinkage: float = 0.05) -> QuadraticDiscriminant:
    """Fits on every labelled row outside the held-out remainder; only class counts and moments reach the driver.

    Labels other than 0 and 1 and null labels are left out; a document with several label rows counts with its greatest.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(F.coalesce(crc_mod("doc_id", held_out_mod) != held_out_remainder, F.lit(False)))
    rows = document_statistics(docs, id_col, text_col).join(known, "doc_id")
    d = len(FEATURES)
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    count, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums).collect():  # two rows
        count[r.y] = r.n
        total[r.y] = [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                square[r.y, i, j] = square[r.y, j, i] = r[f"q{i}_{j}"]
    return QuadraticDiscriminant.fit(count, total, square, shrinkage)


def score_quality(docs: DataFrame, model: QuadraticDiscriminant, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, held_out_mod: int = 4, held_out_remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every row. Null texts are empty; null ids are not held out; extra columns are not read."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches):
        forget()
        classes = character_classes()
        for batch in batches:
            x = np.array([statistics(t or "", classes) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod(id_col, held_out_mod) == held_out_remainder, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out")).mapInArrow(kernel, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: QuadraticDiscriminant, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, whole and with all columns, whose text scores at least the threshold."""
    at = docs.columns.index(text_col)

    def kernel(batches):
        forget()
        classes = character_classes()
        for batch in batches:
            x = np.array([statistics(t or "", classes) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(kernel, docs.schema)
