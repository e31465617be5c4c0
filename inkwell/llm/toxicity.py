"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = logistic(w.x - t_k): one weight vector shared by all grades, and ordered thresholds t_1 < t_2 < ...
x marks which hashed words a text holds. Labels say only whether a document is toxic; toxic documents of the
training sample are graded 1 to `grades` by how many distinct words they hold that mark toxic documents, at equal
shares. A document's result is its expected grade, the sum of P(grade >= k) over k.

The model is fitted on the driver to a bounded sample of labelled documents, `sample_rows` of them at most, chosen by
hash of the id; every document is scored, in place, with no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch_of, map_batches, texts

FEATURES = 1 << 18
TOKEN = re.compile(r"\w+")


def feature_ids(text: str) -> list[int]:
    """Numbers of the distinct words of a text."""
    return [xxhash.xxh64_intdigest(w.encode()) % FEATURES for w in set(TOKEN.findall(text.lower()))]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row for each score."""
        return logistic(scores[:, None] - self.thresholds[None])


def _seen(docs: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """How many of the chosen documents hold each feature."""
    out = np.zeros(FEATURES, np.int64)
    for k in np.flatnonzero(chosen):
        np.add.at(out, docs[k], 1)
    return out


def grade_toxic(docs: list[np.ndarray], toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for documents that are not toxic, else 1 to `grades` by the number of marking words."""
    seen = [_seen(docs, toxic == flag) for flag in (0, 1)]
    n = np.bincount(toxic, minlength=2) + 1
    marks = (seen[1] >= 5) & (np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0]) > 3)
    hits = np.array([int(marks[d].sum()) if t else 0 for d, t in zip(docs, toxic, strict=True)])
    steps = np.quantile(hits[toxic == 1], [k / grades for k in range(1, grades)]) if toxic.any() else np.zeros(grades - 1)
    return np.where(toxic == 1, 1 + (hits[:, None] > steps[None]).sum(1), 0)


def telling(docs: list[np.ndarray], positive: np.ndarray, least_z: float) -> np.ndarray:
    """Which features' log-odds between positive and other documents are `least_z` standard errors from zero."""
    seen = [_seen(docs, positive == flag) + 0.5 for flag in (False, True)]
    odds = np.log(seen[1] / ((positive == 1).sum() + 1)) - np.log(seen[0] / ((positive == 0).sum() + 1))
    return np.abs(odds) >= least_z * np.sqrt(1 / seen[0] + 1 / seen[1])


def loss(p: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with the penalty, and its gradient; `p` is the weights and then the thresholds."""
    n, m = len(y), len(p) - grades
    s = np.bincount(row, p[col], n)
    a = np.hstack([np.ones((n, 1)), logistic(s[:, None] - p[None, m:]), np.zeros((n, 1))])
    low, high = a[np.arange(n), y], a[np.arange(n), y + 1]
    chance = np.maximum(low - high, 1e-9)
    grad = np.zeros_like(p)
    grad[:m] = np.bincount(col, (low + high - 1)[row], m) / n + ridge * p[:m]
    for k in range(grades):
        grad[m + k] = (np.where(y == k + 1, low * (1 - low), 0) - np.where(y == k, high * (1 - high), 0)) @ (1 / chance) / n
    return float(-np.log(chance).mean() + ridge / 2 * p[:m] @ p[:m]), grad


def fit(docs: list[np.ndarray], y: np.ndarray, grades: int, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-5, least_z: float = 3.0) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by Adam over all rows, on the features that tell grade 0 from the rest.

    Without that choice hundreds of thousands of rare words fit any sample, and few marking words keep a weight.
    """
    kept = telling(docs, y > 0, least_z)
    chosen = [np.asarray(d, int)[kept[d]] for d in docs]
    row = np.repeat(np.arange(len(docs)), [len(d) for d in chosen])
    used, col = np.unique(np.concatenate([np.zeros(0, int), *chosen]), return_inverse=True)
    n, m = len(docs), len(used)
    share = np.array([(y >= k).mean() if n else 0.5 for k in range(1, grades + 1)]).clip(1e-3, 1 - 1e-3)
    p = np.concatenate([np.zeros(m), np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(grades) * 1e-3)])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1 if n else 1):
        _, grad = loss(p, row, col, y, grades, ridge)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        p[m:] = np.maximum.accumulate(p[m:] + np.arange(grades) * 1e-9)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = p[:m]
    return OrdinalModel(weights, p[m:].copy())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fit to at most `sample_rows` labelled documents; a document with several labels is toxic if one says so."""
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # no more than sample_rows, so it may be broadcast
    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").join(F.broadcast(chosen), "doc_id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.array(feature_ids(t), "<u4").tobytes() for t in texts(batch)]
        return batch_of(doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.binary()), toxic=batch.column("toxic"))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted(map_batches(plain, lambda: work, f"doc_id {kind}, ids binary, toxic int").collect(), key=lambda r: (r["doc_id"], r["ids"]))
    found = [np.frombuffer(r["ids"], "<u4") for r in rows]
    toxic = np.array([min(1, max(0, r["toxic"])) for r in rows], int)
    return fit(found, grade_toxic(found, toxic, grades), grades)


def score_toxicity(docs: DataFrame, model: OrdinalModel, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the most that is likelier than not), p_toxic, toxic, for every row.

    Null and empty texts have no features and get the thresholds' own chances; texts may be as long as a cell can be.
    Repeated rows are scored each for itself; other columns, whatever their names, are not read. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        weights, thresholds = shared.value
        fitted, known = OrdinalModel(weights, thresholds), {}

        def weigh(word: str) -> float:
            if len(known) > 500_000:
                known.clear()
            value = known[word] = float(weights[xxhash.xxh64_intdigest(word.encode()) % FEATURES])
            return value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            get = known.get
            totals = np.array([sum(v if (v := get(w)) is not None else weigh(w) for w in sorted(set(TOKEN.findall(t.lower())))) for t in texts(batch)])
            chances = fitted.at_least(totals)
            return batch_of(
                doc_id=batch.column("doc_id"), severity=pa.array(chances.sum(1).round(6)), grade=pa.array((chances > 0.5).sum(1).astype(np.int32)),
                p_toxic=pa.array(chances[:, 0].round(6)), toxic=pa.array(chances[:, 0] > limit),
            )

        return work

    return map_batches(docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text"), make, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")
