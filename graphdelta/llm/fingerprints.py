"""Order MinHash fingerprints of documents.

Every k-mer of characters is numbered by its occurrence (first, second, ...), so
repeats count.  The numbered k-mers are dealt by hash into ``BINS`` bins; each bin
keeps its ``KEEP`` smallest, puts them back into text order and hashes them as a
tuple.  Two texts agree in a bin only if they share those k-mers in that order,
which makes the share of agreeing bins follow edit distance rather than content
alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import id_text, materialise, partitions_for, slices

K = 6
BIN_BITS = 5
BINS = 1 << BIN_BITS
KEEP = 2
ROWS_PER_TASK = 50_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted high bits and the positions they come from, equal ones in order of
    position; the low bits of a word carry the position."""
    bits = np.uint64(max(1, len(values).bit_length()))
    packed = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    return packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def signature(text: str) -> np.ndarray:
    """32-bit hash per bin, 0 for an empty bin.  A text shorter than a k-mer is
    one k-mer."""
    out = np.zeros(BINS, dtype=np.uint32)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(chars)
    if not n:
        return out
    k = min(K, n)
    chars = chars.astype(np.uint64) + np.uint64(1)
    kmers = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        kmers = kmers * _B + chars[j:n - k + 1 + j]
    kmers = _mix(kmers)
    high, at = _by_value(kmers)
    index = np.arange(len(kmers))
    first = np.maximum.accumulate(np.where(np.r_[True, high[1:] != high[:-1]], index, 0))
    occurrence = np.empty(len(kmers), dtype=np.uint64)
    occurrence[at] = (index - first).astype(np.uint64)
    numbered = _mix(kmers + occurrence * _A)
    high, at = _by_value(numbered)
    # the sort by value is also a sort by bin, the bin being the highest bits
    shift = np.uint64(64 - BIN_BITS - max(1, len(kmers).bit_length()))
    edges = np.searchsorted(high >> shift, np.arange(BINS + 1, dtype=np.uint64))
    lo, size = edges[:-1], np.diff(edges)
    full = np.flatnonzero(size)
    picked = np.minimum(lo[full][:, None] + np.arange(KEEP), len(kmers) - 1)
    place = np.where(np.arange(KEEP) < size[full][:, None], at[picked], len(kmers))
    place.sort(axis=1)  # text order; absent ones last
    padded = np.r_[kmers, np.uint64(0)]
    value = np.zeros(len(full), dtype=np.uint64)
    for j in range(KEEP):
        value = _mix(value * _A + padded[place[:, j]] + np.uint64(j + 1))
    out[full] = np.maximum(value >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing bins among those that either text fills; 1 if neither
    text has a character."""
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return 1.0 if not n else float(((a == b) & filled).sum()) / n


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _row(doc, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> dict:
    changed = edited(text, following)
    changed_sig = sig if changed == text else signature(changed)
    return {"doc_id": doc, "n_chars": len(text),
            "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": text_of(sig), "edited_fingerprint": text_of(changed_sig),
            "near_edited": likeness(sig, changed_sig), "near_next": likeness(sig, next_sig)}


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Fingerprint of every text alone: (doc_id, fingerprint), without a shuffle.
    Null and empty texts have the fingerprint of empty bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"),
                 pa.array([text_of(signature(t)) for t in b.column("text").to_pylist()],
                          pa.string())], names=["doc_id", "fingerprint"])
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is
    replaced by the start of the next document (descending id; after the last
    the first).

    Rows of equal id follow each other by descending text, null ids come last.
    A single document is its own next one; no rows give no rows; null texts are
    empty.  The documents are range-partitioned by id once and streamed, two at a
    time; where a partition ends, the next one's first document is joined by
    partition number, so only one document for each partition is handled apart.
    """
    rows = id_text(docs, id_col, text_col)
    parts = partitions_for(rows, rows.select("doc_id").count(), ROWS_PER_TASK)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    kind = "part int, edge string, text string, " + COLUMNS
    empty = dict.fromkeys(("part", "edge", "text", "doc_id", "n_chars", "edited_sha256",
                           "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    schema = pa.schema([("part", pa.int32()), ("edge", pa.string()), ("text", pa.string()),
                        ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                        ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                sig = signature(text)
                if held is None:
                    out.append(empty | {"part": part, "edge": "first", "doc_id": doc, "text": text})
                else:
                    out.append(empty | _row(*held, text, sig))
                held = (doc, text, sig)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(
                [empty | {"part": part, "edge": "last", "doc_id": held[0], "text": held[1]}], schema)

    done = materialise(rows.repartitionByRange(parts, *order[:1]).sortWithinPartitions(*order)
                       .mapInArrow(stream, kind))
    spark = docs.sparkSession
    # partition numbers only: one integer for each task that had rows
    used = sorted(r.part for r in done.where("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part int, next_part int")
    last = done.where("edge = 'last'").select("part", "doc_id", "text")
    first = done.where("edge = 'first'").select(F.col("part").alias("next_part"),
                                                F.col("text").alias("next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [_row(r["doc_id"], r["text"], signature(r["text"]), r["next_text"],
                        signature(r["next_text"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(schema)[3:]))

    edges = (last.join(after, "part").join(first, "next_part")
             .select("doc_id", "text", "next_text").mapInArrow(close, COLUMNS))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return done.where("edge is null").select(*names).unionByName(edges)
