"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimisers only: in every run of ``RUN`` word k-mers the one
of the least hash, so equal passages keep suffixes at equal places.  Suffixes
whose first words occur nowhere else can't be in a repeated passage and are
dropped.  The others are sorted over the whole corpus; each is compared with its
neighbours, and the common part is extended to the right and to the left.

Where more suffixes share their first words than all meet as neighbours, the
partner of a match can lie anywhere among them, in another part of the sort too.  There
the windows of ``least`` words around each suffix are counted as well: equal ones are a
match.  All other keys lie whole in one part, so the result does not depend on the
number of parts.

A passage of ``least`` words has a suffix within its first ``RUN`` words, so the
words that two such suffixes must share (``least`` - ``RUN`` + 1) and ``RUN`` words
on either side show every match of ``least`` words, and the spans of successive
suffixes join into the whole passage.
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

LEAST_WORDS = 50
KMER = 8
RUN = 16
NEIGHBOURS = 4  # on either side, in sorted order
SUFFIXES_PER_PART = 500_000
BROADCAST_KEYS = 500_000  # of 8 bytes; more are joined by a shuffle

SUFFIX = "key long, right binary, left binary, after int, before int, doc long, th long, at long"
SPAN = "doc long, th long, start long, end long"
_SUFFIX = pa.schema([("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()),
                     ("after", pa.int32()), ("before", pa.int32()), ("doc", pa.int64()),
                     ("th", pa.int64()), ("at", pa.int64())])


def minimisers(words: np.ndarray, kmer: int, run: int) -> np.ndarray:
    """Places of the least k-mer hash (the first of equal ones) of every ``run``
    successive k-mers."""
    hashes = window_hashes(words, kmer, 1)
    if len(hashes) < run:
        return np.zeros(0, dtype=np.int64)
    out = []
    for lo in range(0, len(hashes) - run + 1, 1 << 16):
        part = hashes[lo:lo + (1 << 16) + run - 1]
        runs = np.lib.stride_tricks.sliding_window_view(part, run)
        out.append(runs.argmin(axis=1) + np.arange(len(runs)) + lo)
    return np.unique(np.concatenate(out))


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes()),
        pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _words_of(column: pa.Array, run: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(-1, run)


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal words from the beginning, row by row."""
    differ = np.c_[a != b, np.ones(len(a), dtype=bool)]
    return np.minimum(differ.argmax(axis=1), limit)


class Context:
    """Suffixes in order, with the words around their keys."""

    def __init__(self, batch: pa.RecordBatch, run: int):
        def get(name):
            return batch.column(batch.schema.get_field_index(name))
        self.key, self.doc, self.th, self.at = (get(n).to_numpy() for n in ("key", "doc", "th", "at"))
        self.after, self.before = get("after").to_numpy(), get("before").to_numpy()
        self.right, self.left = _words_of(get("right"), run), _words_of(get("left"), run)

    def spans(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]], fixed: int,
              least: int) -> np.ndarray:
        """(doc, th, start, end) of the suffixes that match in one of the pairs (i, j),
        as far as their matches reach."""
        start, end = self.at.copy(), self.at.copy()
        for i, j in pairs:
            same = self.key[i] == self.key[j]
            i, j = i[same], j[same]
            right = _common(self.right[i], self.right[j], np.minimum(self.after[i], self.after[j]))
            left = _common(self.left[i], self.left[j], np.minimum(self.before[i], self.before[j]))
            long = left + fixed + right >= least
            for k in (i[long], j[long]):  # no suffix stands twice on one side
                start[k] = np.minimum(start[k], self.at[k] - left[long])
                end[k] = np.maximum(end[k], self.at[k] + fixed + right[long])
        hit = end > self.at
        return np.stack([self.doc[hit], self.th[hit], start[hit], end[hit]], axis=1)


def suffixes(rows: DataFrame, least: int, kmer: int, run: int) -> DataFrame:
    """Suffixes at minimisers whose first words occur elsewhere too."""
    fixed = least - run + 1

    def places(words: np.ndarray) -> np.ndarray:
        at = minimisers(words, kmer, run)
        return at[at + fixed <= len(words)]

    def windows(row: dict):
        words = word_hashes(row["text"].encode("utf-8", "surrogatepass"))
        at = places(words)
        return at.astype(np.uint32), window_hashes(words, fixed)[at], None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                words = word_hashes(r["text"].encode("utf-8", "surrogatepass"))
                n = len(words)
                at = np.flatnonzero(repeats.flags(r["found"], n))
                short = np.r_[(words >> np.uint64(32)), np.zeros(run + 1, np.uint64)].astype(">u4")
                step = np.arange(run)
                before, after = np.minimum(at, run), np.minimum(n - at - fixed, run)
                left = np.where(step < before[:, None], short[np.maximum(at[:, None] - 1 - step, 0)], 0)
                right = np.where(step < after[:, None],
                                 short[np.minimum(at[:, None] + fixed + step, n)], 0)
                out.append((window_hashes(words, fixed)[at].view(np.int64), right.astype(">u4"),
                            left.astype(">u4"), after, before, np.full(len(at), r["doc"]),
                            np.full(len(at), r["th"]), at))
            key, right, left, after, before, doc, th, at = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), _binary(right), _binary(left), pa.array(after.astype(np.int32)),
                 pa.array(before.astype(np.int32)), pa.array(doc), pa.array(th), pa.array(at)],
                schema=_SUFFIX)

    found = materialise(repeats.by_document(
        repeats.repeated(rows, repeats.parts_for(rows), False, windows)))
    release(rows.sparkSession)
    texts = rows.select("doc", "th", "text").dropDuplicates(["doc", "th"])
    return texts.join(found, ["doc", "th"]).select("doc", "th", "text", "found").mapInArrow(build, SUFFIX)


def crowded_keys(kept: DataFrame) -> DataFrame:
    """Keys of more suffixes than all meet each other as neighbours, ``(key, crowded)``;
    marked for broadcast if they are, counted, within the bound."""
    keys = materialise(kept.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
                       .where(F.col("c") > NEIGHBOURS + 1).select("key", F.lit(True).alias("crowded")))
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def crowded_windows(rows: DataFrame, kept: DataFrame, crowded: DataFrame, least: int, run: int) -> DataFrame:
    """Spans of the windows of ``least`` words that stand elsewhere too, around the
    suffixes whose key is too frequent for each to meet each as neighbours.

    Equal windows have suffixes at equal places, so all of them are read.
    """
    places = kept.select("key", "doc", "th", "at").join(crowded, "key").groupBy("doc", "th").agg(
        F.collect_list("at").alias("places"))

    def windows(row: dict):
        words = word_hashes(row["text"].encode("utf-8", "surrogatepass"))
        first = np.array(row["places"], dtype=np.int64)[:, None] - np.arange(run)
        pos = np.unique(first[(first >= 0) & (first + least <= len(words))])
        return (pos.astype(np.uint32), window_hashes(words, least)[pos],
                (window_hashes(words, least, 1)[pos] >> np.uint64(32)).astype(np.uint32))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                pos = np.sort(np.frombuffer(r["positions"], dtype=np.uint32).astype(np.int64))
                if not len(pos):
                    continue
                cut = np.flatnonzero(np.diff(pos) > 1)
                start, end = pos[np.r_[0, cut + 1]], pos[np.r_[cut, len(pos) - 1]] + least
                out.append((np.full(len(start), r["doc"]), np.full(len(start), r["th"]), start, end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                 names=["doc", "th", "start", "end"])

    asked = materialise(rows.select("doc", "th", "text").dropDuplicates(["doc", "th"])
                        .join(places, ["doc", "th"]))
    return repeats.repeated(asked, repeats.parts_for(asked), True, windows).mapInArrow(spans, SPAN)


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, kmer: int = KMER, run: int = RUN,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, th, spans): for every row the stretches of words, as (start,
    end) from 0, end exclusive, that lie in passages of at least ``least`` words
    which also stand elsewhere, in another document or in the same one.

    Words are runs of characters other than ASCII white space, unchanged.  Every
    occurrence is shown, the first one too.  Null and empty texts and those of
    fewer words have no spans.  Rows equal in id and text are one document.  Of
    several matches of a suffix those with its ``NEIGHBOURS`` on either side, in the
    order by right, then left context, are extended; where its key has more suffixes,
    equal windows of ``least`` words are counted too, so no match is lost.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spark, fixed = docs.sparkSession, least - run + 1
    kept = materialise(suffixes(rows, least, kmer, run))
    release(spark)
    crowded = crowded_keys(kept)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-kept.count() // SUFFIXES_PER_PART))
    order = ["right", "left", "doc", "th", "at"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches(([held] if held is not None else []) + [batch])
            both = both.combine_chunks().to_batches()[0]
            index = np.arange(both.num_rows)
            near = ((index[:-d], index[d:]) for d in range(1, NEIGHBOURS + 1))
            if len(spans := Context(both, run).spans(near, fixed, least)):
                yield pa.RecordBatch.from_arrays([pa.array(spans[:, c]) for c in range(4)],
                                                 names=["doc", "th", "start", "end"])
            held = both.slice(max(0, both.num_rows - NEIGHBOURS))

    # The sort is global.  Its parts end between keys, so that all suffixes of a key meet
    # in one; only within a crowded key may they end at any suffix, and what lies beyond
    # is found by its windows.
    ends = ["key", *(F.when(F.col("crowded"), F.col(c)) for c in order)]
    spans = (kept.join(crowded, "key", "left").repartitionByRange(parts, *ends)
             .sortWithinPartitions("key", *order).drop("crowded").mapInArrow(compare, SPAN))
    spans = spans.union(crowded_windows(rows, kept, crowded, least, run))
    whole = spans.distinct().groupBy("doc", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("all"))
    # overlapping and touching spans become one
    merged = F.aggregate(
        "all", F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda out, s: F.when((F.size(out) == 0) | (F.get(out, F.size(out) - 1)["end"] < s["start"]),
                              F.concat(out, F.array(s)))
        .otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(
            F.get(out, F.size(out) - 1)["start"].alias("start"),
            F.greatest(F.get(out, F.size(out) - 1)["end"], s["end"]).alias("end"))))))
    return (rows.select("doc_id", "doc", "th")
            .join(whole.select("doc", "th", merged.alias("spans")), ["doc", "th"], "left")
            .select("doc_id", "doc", "th", F.coalesce(
                "spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("n_repeated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
