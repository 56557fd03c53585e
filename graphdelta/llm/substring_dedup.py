"""Repeated passages by level-wise doubling.

At the first level the hashes of all windows of a few words are searched for
repeats.  A window of twice the length can only be repeated if the two that it
is made of are, so every further level hashes and searches those alone, until
the wanted length is reached or no candidate is left.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm import repeats
from graphdelta.llm.common import materialise, release, slices
from graphdelta.llm.textops import window_hashes, word_hashes

WINDOW_WORDS = 35

SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def levels(window: int, start: int) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def covered(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Mask of the words that windows at these starts (a mask) cover."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_windows(rows: DataFrame, window: int, start: int) -> DataFrame:
    """(doc, th, found): starts of the windows whose words also start elsewhere.
    ``rows`` as ``repeats.keyed`` gives them."""
    parts = repeats.parts_for(rows)
    found, steps = None, levels(window, start)
    for before, length in zip([0, *steps], steps):
        last = length == window

        def windows(row: dict, before: int = before, length: int = length, last: bool = last):
            words = word_hashes(row["text"].encode("utf-8", "surrogatepass"))
            hashes = window_hashes(words, length)
            if before:
                half = repeats.flags(row["found"], len(words) - before + 1)
                at = np.flatnonzero(half[:len(hashes)] & half[length - before:][:len(hashes)])
            else:
                at = np.arange(len(hashes))
            more = window_hashes(words, length, 1)[at] >> np.uint64(32) if last else None
            return at.astype(np.uint32), hashes[at], more

        source = rows if found is None else rows.join(found, ["doc", "th"])
        found = materialise(repeats.by_document(
            repeats.repeated(source, parts, last, windows)))
        release(rows.sparkSession)
        if found.isEmpty():
            break
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, start: int = 9,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left when every word is
    removed that is covered by a window of ``window`` consecutive words which
    also starts anywhere else, the same document included.  Windows are judged
    on the input; ``kept`` is the words left, joined by one space.

    One row for each input row.  Null and empty texts have no words, texts of
    fewer words no window.  A repeated row repeats all its windows.  Texts are
    compared whole; equal windows are told by 96 bits of hash.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    found = repeated_windows(rows, window, start)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                words = r["text"].encode("utf-8", "surrogatepass").split()
                n, removed = len(words), 0
                if r["found"]:
                    gone = covered(repeats.flags(r["found"], n - window + 1), n, window)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((r["doc_id"], n, removed, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(found, ["doc", "th"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(cut, SCHEMA)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed",
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
