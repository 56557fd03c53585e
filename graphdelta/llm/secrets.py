"""Secret scan: fixed rules find the base spans, a character convolutional network
reads every further candidate with its surroundings and adds the likely ones.

The network (numpy) is trained on the findings of the rules, which label the
candidates of all documents; a bounded sample of them by hash is learnt from.  Its
scores are calibrated on a held-out part, where the threshold is set as high as the
wanted recall allows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import id_text, materialise, slices

KINDS = ("assign", "access", "hex", "model")  # order of equal starts
# Patterns and lengths of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs are taken whole, so asking for the length at once finds the same spans
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
# what the network reads: whole runs of 12 and more such characters, and what is left
# of a stretch of ASCII marks, letters and digits beside them, if it is as long
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
STRETCH = re.compile(r"[!-~]{12,}")
MARKS = "!\"#$%&'()*,.:;<>?@[\\]^`{|}~"
CANDIDATE_LEAST = 12

#: Bound of the training sample: candidates of either label.
FIT_EACH = 1_500
RECALL = 0.95
LEAST_P = 0.0  # no floor: the recall alone sets the threshold

CONTEXT, INSIDE = 24, 56  # characters read before/after, and of a candidate at a time
SYMBOLS, EMBED, FILTERS, REACH = 48, 12, 24, 5



def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in STRETCH.finditer(text):
        runs = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
        out += runs
        edges = [m.start(), *(x for r in runs for x in r), m.end()]
        for start, end in zip(edges[::2], edges[1::2]):
            part = text[start:end]
            start += len(part) - len(part.lstrip(MARKS))
            end -= len(part) - len(part.rstrip(MARKS))
            if end - start >= CANDIDATE_LEAST:
                out.append((start, end))
    return sorted(out)


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A long candidate as overlapping pieces of ``INSIDE`` characters, up to its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(i, i + INSIDE) for i in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


def overlaps(span: tuple[int, int], spans: list[tuple[int, int, int]]) -> bool:
    return any(s < span[1] and span[0] < e for s, _, e in spans)


def _symbol_table() -> np.ndarray:
    """Characters to symbols: hex letters, other letters by case, digits and the
    marks around secrets stand apart; the rest by class."""
    table = np.full(129, 1, dtype=np.uint8)  # 1: other ASCII; 2: beyond ASCII; 0: nothing
    table[128] = 2
    for i in range(10):
        table[48 + i] = 3
    for i in range(26):
        table[97 + i] = 4 + i
        table[65 + i] = 30 if i < 6 else 31
    for i, c in enumerate(" \n\t:=\"'/+_-.@&?"):
        table[ord(c)] = 32 + i
    return table


_TABLE = _symbol_table()
LENGTH = 2 * CONTEXT + INSIDE


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a piece of a candidate between its surroundings, and where it lies:
    (2, LENGTH), the second row 1 inside the piece."""
    out = np.zeros((2, LENGTH), dtype=np.uint8)

    def put(s: str, at: int, inside: int) -> None:
        codes = np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
        out[0, at:at + len(s)] = _TABLE[codes]
        out[1, at:at + len(s)] = inside

    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    put(before, CONTEXT - len(before), 0)
    value = text[start:end]
    put(value, CONTEXT, 1)
    put(after, CONTEXT + len(value), 0)
    return out


class CharCNN:
    """Embedding, one convolution, the largest activation of every filter inside
    and outside the candidate, and a logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)),
                  "conv": rng.normal(0, 0.15, (REACH * (EMBED + 1), FILTERS)),
                  "shift": np.zeros(FILTERS),
                  "out": rng.normal(0, 0.1, 2 * FILTERS),
                  "bias": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.offset, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, x: np.ndarray):
        sym, inside = x[:, 0], x[:, 1].astype(np.float32)
        e = np.concatenate([self.p["embed"][sym] * (sym > 0)[:, :, None], inside[:, :, None]], 2)
        steps = LENGTH - REACH + 1
        cols = np.concatenate([e[:, j:j + steps] for j in range(REACH)], axis=2)
        act = np.maximum(cols @ self.p["conv"] + self.p["shift"], 0)
        zone = inside[:, REACH // 2:REACH // 2 + steps, None]
        at = [(act * zone).argmax(1), (act * (1 - zone)).argmax(1)]
        n, f = np.arange(len(x))[:, None], np.arange(FILTERS)
        pooled = np.concatenate([(act * zone)[n, at[0], f], (act * (1 - zone))[n, at[1], f]], 1)
        return cols, at, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + rows])[3] for i in range(0, len(x), rows)]
                              or [np.zeros(0, np.float32)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * self.logits(x) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        cols, at, pooled, z = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y).astype(np.float32) / len(x)
        n, f = np.arange(len(x))[:, None], np.arange(FILTERS)
        d_pool = d[:, None] * self.p["out"] * (pooled > 0)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32),
             "shift": d_pool[:, :FILTERS].sum(0) + d_pool[:, FILTERS:].sum(0),
             "conv": np.zeros_like(self.p["conv"]), "embed": np.zeros_like(self.p["embed"])}
        for part, where in enumerate(at):
            dz = d_pool[:, part * FILTERS:(part + 1) * FILTERS]
            picked = cols[n, where]  # rows, filters, REACH * (EMBED + 1)
            g["conv"] += np.einsum("nf,nfk->kf", dz, picked)
            back = (dz[:, :, None] * self.p["conv"].T[f]).reshape(len(x), FILTERS, REACH, EMBED + 1)
            sym = x[:, 0][n[:, :, None], where[:, :, None] + np.arange(REACH)]
            np.add.at(g["embed"], sym.ravel(), back[..., :EMBED].reshape(-1, EMBED))
        g["embed"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64,
            rate: float = 0.01) -> None:
        rng = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self._gradients(x[order[i:i + batch]], y[order[i:i + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Logistic calibration on held-out rows (bounded Newton steps,
        smoothed targets, a prior at no change), then the highest threshold that keeps the recall."""
        z = self.logits(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a = np.array([1.0, 0.0])
        design = np.c_[z, np.ones(len(z))]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
            hess = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2)
            step = np.linalg.solve(hess, design.T @ (p - target) + (a - [1.0, 0.0]))
            a = a - np.clip(step, -0.5, 0.5)
        self.scale, self.offset = max(float(a[0]), 1e-3), float(a[1])
        found = np.sort(self.probability(x[y > 0]))
        self.threshold = float(found[int((1 - recall) * len(found))])


@dataclass
class SecretModel:
    network: CharCNN | None  # None: nothing to learn from, the rules stand alone


def labelled_windows(text: str) -> list[tuple[int, bytes]]:
    """Windows of base findings (label 1) and of the other candidates (0).  A
    finding is shown once as it stands and, where the rule went by the word
    before the value, once by the value alone, so that the value counts too."""
    base, out = base_spans(text), []

    def show(label: int, shown: str, start: int, end: int) -> None:
        out.extend((label, window(shown, *p).tobytes()) for p in pieces(start, end))
    for start, kind, end in base:
        if kind == 0:
            m = ASSIGN.match(text, start)
            show(1, text, m.start(2), m.end(2))
            show(1, text[m.start(2):m.end(2)], 0, m.end(2) - m.start(2))
        else:
            show(1, text, start, end)
    for s in candidates(text):
        if not overlaps(s, base):
            show(0, text, *s)
    words = re.findall(r"\S{12,}", text)[:2]  # plain long words are no secrets
    for w in words:
        if (i := text.find(w)) >= 0 and not overlaps((i, i + len(w)), base):
            show(0, text, i, i + len(w))
    return out


def fit_secret_model(docs: DataFrame, max_docs: int | None = None, each: int = FIT_EACH,
                     recall: float = RECALL, id_col: str = "doc_id",
                     text_col: str = "text") -> SecretModel:
    """Train on at most ``each`` distinct candidates of either label, those of the
    smallest hash in all documents (or in ``max_docs`` documents of the smallest id
    hash).  Under 20 of a label there is nothing to learn from and the rules stand
    alone."""
    rows = id_text(docs, id_col, text_col)
    if max_docs is not None:
        chosen = (rows.select("doc_id").where("doc_id is not null").distinct()
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
        rows = rows.join(chosen, "doc_id", "left_semi")

    def least(found: dict[bytes, int]) -> dict[bytes, int]:
        return {w: found[w] for w in sorted(found, key=lambda w: (found[w], w))[:each]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's candidates of the smallest hashes: the smallest of all are among them."""
        kept: list[dict[bytes, int]] = [{}, {}]
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                for label, w in labelled_windows(t):
                    if w not in kept[label]:
                        kept[label][w] = int.from_bytes(
                            hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
            kept = [least(k) if len(k) > 4 * each else k for k in kept]
        for label, found in enumerate(map(least, kept)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found), pa.int32()), pa.array(list(found), pa.binary()),
                 pa.array(list(found.values()), pa.int64())], names=["label", "shown", "hash"])

    shown = materialise(rows.select("text").mapInArrow(run, "label int, shown binary, hash long"))
    got = []
    for label in (0, 1):
        got += (shown.where(F.col("label") == label).distinct()
                .orderBy("hash", "shown").limit(each).collect())
    y = np.array([r.label for r in got], dtype=np.float32)
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return SecretModel(None)
    x = np.stack([np.frombuffer(r.shown, np.uint8).reshape(2, LENGTH) for r in got])
    order = np.random.default_rng(5).permutation(len(y))
    held, fitted = np.split(order, [len(y) // 4])
    network = CharCNN()
    network.fit(x[fitted], y[fitted])
    network.calibrate(x[held], y[held], recall)
    return SecretModel(network)


def find_spans(texts: list[str], model: SecretModel) -> list[list[tuple[int, int, int]]]:
    """Per text all spans (start, kind, end): the base ones and the candidates
    apart from them that the network takes for secrets."""
    found = [base_spans(t) for t in texts]
    if model.network is None:
        return found
    asked = [(i, s, p) for i, t in enumerate(texts) for s in candidates(t)
             if not overlaps(s, found[i]) for p in pieces(*s)]
    taken = set()
    for lo in range(0, len(asked), 1024):
        part = asked[lo:lo + 1024]
        p = model.network.probability(np.stack([window(texts[i], *at) for i, _, at in part]))
        taken |= {(i, s) for (i, s, _), q in zip(part, p) if q >= model.network.threshold}
    for i, (start, end) in taken:
        found[i].append((start, 3, end))
    return [sorted(f) for f in found]


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """All secrets of every row: (doc_id, spans), spans an array of (kind, start,
    end) in code points, end exclusive.

    One pass without a shuffle over whole texts.  A null or empty text has no
    spans; repeated rows are scanned each; null ids stay null.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = find_spans(b.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"),
                 pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f]
                           for f in found], kind)], names=["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")

    def of(kind):
        return F.filter(spans, lambda s: s["kind"] == kind)

    base = F.filter(spans, lambda s: s["kind"] != "model")
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
