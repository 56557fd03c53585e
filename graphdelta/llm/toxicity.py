"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct words and word beginnings, hashed.  One
weight vector serves all grades; ordered thresholds cut its score into them:
P(grade > k) = sigmoid(w.x - t_k).  Expected severity is the sum of those
probabilities.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import id_text, slices

HASH_BITS = 18
WIDTH = 1 << HASH_BITS
#: Bound of the labelled rows that a model is fitted on.
FIT_ROWS = 6000
CHUNK_ROWS = 500  # rows whose gradient is worked out at a time
HELD_OUT = 0.25
GRADES = 4  # 0: not toxic, 1 to 3: rising severity
LEAST_ROWS = 5
PREFIXES = (4, 5)  # bytes of word beginnings

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def _bucket(x: np.ndarray, tag: int) -> np.ndarray:
    x = (x + np.uint64(tag)) * _A
    x = (x ^ (x >> np.uint64(31))) * _B
    return (x >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Distinct hashed features.  Words are runs of letters and digits, lower
    case; 16 bytes and the length tell a word."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass") + b" " * 17, dtype=np.uint8)
    mask = _LETTER[raw].astype(np.int8)
    step = np.diff(mask, prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, dtype=np.int32)
    size = end - start
    head = raw[start[:, None] + np.arange(16)] * (np.arange(16) < size[:, None])
    lo, hi = np.ascontiguousarray(head.astype(np.uint8)).view("<u8").T
    found = [_bucket(lo ^ (hi * _B) ^ (size.astype(np.uint64) << np.uint64(56)), 1)]
    for n in PREFIXES:
        long = size >= n
        found.append(_bucket(lo[long] & np.uint64((1 << 8 * n) - 1), n))
    return np.unique(np.concatenate(found))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one for each feature, shared by all thresholds
    thresholds: np.ndarray  # ascending, one between each two grades
    cut: float = 0.5  # P(grade > 0) from which a document is rejected

    def above(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        score = float(self.weights[found].sum())
        return _sigmoid(score - self.thresholds)


def log_odds(rows: list[np.ndarray], marked: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each feature between marked rows and the others; 0
    for features of fewer than ``LEAST_ROWS`` rows, which say nothing yet."""
    seen = [np.zeros(WIDTH), np.zeros(WIDTH)]
    for r, m in zip(rows, marked):
        seen[int(m)][r] += 1
    n = np.bincount(np.asarray(marked, dtype=int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(seen[0] + seen[1] >= LEAST_ROWS, odds, 0.0)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES,
                steps: int = 80, rate: float = 0.03, l2: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows, each feature scaled by its
    log-odds.  The thresholds are kept in order by their gaps, whose logarithms
    are the parameters."""
    y = np.asarray(grades)
    scale = log_odds(rows, y > 0)
    rows = [r[scale[r] != 0] for r in rows]  # the others would never count
    weights = np.zeros(WIDTH)
    share = np.clip([(y > k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    cuts = np.r_[first[0], np.log(np.maximum(np.diff(first), 0.1))]
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(n_grades - 1), np.zeros(n_grades - 1)]

    def ordered(c):
        return c[0] + np.r_[0.0, np.cumsum(np.exp(c[1:]))]

    for step in range(1, steps + 1):
        t = ordered(cuts)
        d_weights, d_t = l2 * weights, np.zeros(n_grades + 1)
        for lo in range(0, len(rows), CHUNK_ROWS):
            part, grade = rows[lo:lo + CHUNK_ROWS], y[lo:lo + CHUNK_ROWS]
            each, columns = np.arange(len(part)), np.concatenate(part)
            owner = np.repeat(each, [len(r) for r in part])
            score = np.bincount(owner, weights[columns] * scale[columns], minlength=len(part))
            above = np.c_[np.ones(len(part)), _sigmoid(score[:, None] - t), np.zeros(len(part))]
            slope = above * (1 - above)
            p = np.maximum(above[each, grade] - above[each, grade + 1], 1e-9) * len(rows)
            d_score = -(slope[each, grade] - slope[each, grade + 1]) / p
            d_weights += np.bincount(columns, d_score[owner] * scale[columns], minlength=WIDTH)
            np.add.at(d_t, grade, slope[each, grade] / p)
            np.add.at(d_t, grade + 1, -slope[each, grade + 1] / p)
        d_t = d_t[1:-1]
        tail = np.cumsum(d_t[::-1])[::-1]
        grads = (d_weights, np.r_[tail[0], tail[1:] * np.exp(cuts[1:])])
        for i, (param, g) in enumerate(((weights, grads[0]), (cuts, grads[1]))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            param -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    return OrdinalModel((weights * scale).astype(np.float32), ordered(cuts))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades for labels that only say toxic or not: 0 for the others; toxic
    documents are cut into thirds by the share of their features that stand out
    in toxic documents (log-odds over 1)."""
    grades = np.zeros(len(rows), dtype=np.int64)
    if not toxic.any():
        return grades
    marked = log_odds(rows, toxic) > 1
    share = np.array([marked[r].mean() if len(r) else 0.0 for r in rows])
    edges = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grades[toxic] = 1 + np.searchsorted(edges, share[toxic], side="left")
    return grades


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS,
                 id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic") -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled rows, those of the smallest id hash.
    A quarter of them, held out of a first fit, sets the rejection threshold (best
    F1); the model itself is fitted on all.  With no labelled rows, or labels of
    one class, it rejects nothing."""
    chosen = (labels.select(labels[id_col].cast("long").alias("doc_id"),
                            labels[label_col].cast("int").alias("label"))
              .where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows rows of 12 bytes: a proven bound for the broadcast
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"),
                 pa.array([features(t).tobytes() for t in b.column("text").to_pylist()],
                          pa.binary())], names=["doc_id", "label", "found"])

    got = (texts.select("doc_id", "label", "text")
           .mapInArrow(run, "doc_id long, label int, found binary")
           .dropDuplicates(["doc_id"]).collect())
    got.sort(key=lambda r: r.doc_id)
    rows = [np.frombuffer(r.found, dtype=np.int32) for r in got]
    toxic = np.array([r.label > 0 for r in got], dtype=bool)
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(WIDTH, np.float32), np.full(GRADES - 1, 30.0))
    grades = severity_grades(rows, toxic)
    order = np.random.default_rng(7).permutation(len(rows))
    held, fitted = np.split(order, [int(len(rows) * HELD_OUT)])
    trial = fit_ordinal([rows[i] for i in fitted], grades[fitted])
    p = np.array([trial.above(rows[i])[0] for i in held])
    truth = toxic[held]
    model = fit_ordinal(rows, grades)
    if truth.any():
        cuts = np.linspace(0.2, 0.8, 25)
        f1 = [2 * (truth & (p >= c)).sum() / max(1, truth.sum() + (p >= c).sum()) for c in cuts]
        best = np.flatnonzero(np.isclose(f1, max(f1)))
        model.cut = float(cuts[best[len(best) // 2]])
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every row: expected severity
    from 0 to 3, P(grade > 0), the most probable grade, and whether p_toxic
    reaches the model's threshold.

    One pass without a shuffle over whole texts; repeated rows are scored each,
    null ids stay null.  A null or empty text has no features and is never
    toxic: severity 0, p_toxic 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [features(t) for t in b.column("text").to_pylist()]
            above = np.array([model.above(f) if len(f) else np.zeros(len(model.thresholds))
                              for f in found])
            edges = np.c_[np.ones(len(found)), above, np.zeros(len(found))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                 pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)),
                 pa.array((above[:, 0] >= model.cut) & [len(f) > 0 for f in found])],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept.  A
    null or empty text is never rejected."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(iter([b]), text=b.schema.names[at]):
                keep = []
                for t in s.column(at).to_pylist():
                    found = features(t or "")
                    keep.append(not len(found) or model.above(found)[0] < model.cut)
                yield s.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
