"""Which window hashes occur more than once in a corpus: one shuffle, packed.

Every task deals the hashes of a block of documents out to parts by their high
bits and sends each part one row of packed arrays; a part sorts its hashes and
returns the positions of those that it has more than once.  A hash that a block
holds several times is repeated for certain: its positions are passed on as
known, spread by document, and only one of them goes to the part, so a window
that fills a third of the corpus adds one entry for each block to its part.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import SLICE_BYTES, id_text, slices

BLOCK_ENTRIES = 400_000
PART_ENTRIES = 4_000_000
LEAST_PARTS = 32
CHUNK = 1 << 16  # positions are sent as 16 bits within chunks of a document

DEALT = "part int, known boolean, owners binary, sizes binary, positions binary, hashes binary, more binary"
FOUND = "doc long, th long, positions binary"
_DEALT = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("owners", pa.binary()),
                    ("sizes", pa.binary()), ("positions", pa.binary()), ("hashes", pa.binary()),
                    ("more", pa.binary())])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, th, text): (doc, th) tells rows apart by id and text; rows
    equal in both share it, which changes nothing for them."""
    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"),
                       F.xxhash64("doc_id", "text").alias("th"), "text")


def parts_for(docs: DataFrame, text_col: str = "text") -> int:
    """Enough parts for the words of all texts."""
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(LEAST_PARTS, chars // 6 // PART_ENTRIES)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def in_order(part: np.ndarray, parts: int) -> np.ndarray:
    """Stable order by part (16-bit numbers are sorted by counting)."""
    return np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")


class Block:
    """Entries of some documents: (doc, th), position and hash (and a second
    hash) of windows."""

    def __init__(self, parts: int, wide: bool):
        self.parts, self.wide = parts, wide
        self.clear()

    def clear(self):
        self.owners, self.sizes, self.pos, self.hash, self.more, self.n = [], [], [], [], [], 0

    def add(self, doc: int, th: int, pos: np.ndarray, hashes: np.ndarray, more) -> None:
        chunk = pos >> 16
        edges = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(pos)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                self.owners.append((doc, th, int(chunk[lo])))
                self.sizes.append(hi - lo)
        self.pos.append(pos & 0xFFFF)
        self.hash.append(hashes)
        if self.wide:
            self.more.append(more)
        self.n += len(pos)

    def rows(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        owners = np.array(self.owners, dtype=np.int64)
        owner = np.repeat(np.arange(len(owners)), self.sizes)
        pos = np.concatenate(self.pos).astype(np.uint16)
        hashes = np.concatenate(self.hash)
        more = np.concatenate(self.more).astype(np.uint32) if self.wide else None
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order[1:]] == hashes[order[:-1]]
        if self.wide:
            equal &= more[order[1:]] == more[order[:-1]]
        again = order[1:][equal]  # all but the first of equal ones
        known = np.zeros(self.n, dtype=bool)
        known[again] = known[order[:-1][equal]] = True
        sent = np.ones(self.n, dtype=bool)
        sent[again] = False
        out = []
        spread = owners[:, 1] % self.parts
        for chosen, is_known in ((np.flatnonzero(sent), False), (np.flatnonzero(known), True)):
            part = spread[owner[chosen]] if is_known else part_of(hashes[chosen], self.parts)
            order = in_order(part, self.parts)
            by_part, part = chosen[order], part[order]
            edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                at = by_part[lo:hi]
                who, sizes = _runs(owner[at])
                h = hashes[at]
                out.append((int(part[lo]), is_known, owners[who].tobytes(),
                            sizes.astype(np.uint32).tobytes(), pos[at].tobytes(),
                            None if is_known else
                            (h if self.wide else h.astype(np.uint32)).tobytes(),
                            more[at].tobytes() if self.wide and not is_known else None))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DEALT)],
                                          schema=_DEALT)


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)]
    return ids[edges[:-1]], np.diff(edges)


def repeated(rows: DataFrame, parts: int, wide: bool,
             windows: Callable[[dict], tuple]) -> DataFrame:
    """(doc, th, positions) of the repeated ones among each row's windows.

    ``rows`` has doc, th, text and what else ``windows`` needs; ``windows`` gives
    a row's positions (uint32), hashes (uint64) and, if ``wide``, further 32 bits.
    A narrow search compares 32 bits and the part, so one entry in a thousand
    may be called repeated without being so; a wide one compares 96 bits.
    ``positions`` is a packed uint32 array; a document may come in several rows.
    """
    names = [c for c in rows.columns if c != "doc_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(parts, wide)
        for b in slices(batches, size=SLICE_BYTES // 2):
            for r in b.to_pylist():
                pos, hashes, more = windows(r)
                if len(pos):
                    block.add(r["doc"], r["th"], pos, hashes, more)
                if block.n >= BLOCK_ENTRIES:
                    yield block.rows()
        if (last := block.rows()) is not None:
            yield last

    def search(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int, bytes]] = []

        def collect(owners, sizes, positions, hit):
            owner = np.repeat(np.arange(len(owners)), sizes)[hit]
            who, n = _runs(owner) if len(owner) else (owner, owner)
            edges = np.r_[0, np.cumsum(n)].astype(np.int64)
            for k, w in enumerate(who):
                doc, th, chunk = owners[w].tolist()
                at = positions[hit[edges[k]:edges[k + 1]]].astype(np.uint32)
                found.append((doc, th, (at + np.uint32(chunk * CHUNK)).tobytes()))

        for is_known in (True, False):
            t = table.filter(pc.equal(table["known"], is_known))
            if not t.num_rows:
                continue
            owners = joined(t["owners"], np.int64).reshape(-1, 3)
            sizes, positions = joined(t["sizes"], np.uint32), joined(t["positions"], np.uint16)
            if is_known:
                hit = np.arange(len(positions))
            else:
                hashes = joined(t["hashes"], np.uint64 if wide else np.uint32)
                order = np.argsort(hashes, kind="stable")
                s = hashes[order]
                equal = s[1:] == s[:-1]
                if wide:
                    # of equal first hashes the second ones decide
                    more = joined(t["more"], np.uint32)
                    mixed = np.flatnonzero(equal & (more[order[1:]] != more[order[:-1]]))
                    if len(mixed):
                        order = np.lexsort((more, hashes))
                        s, m = hashes[order], more[order]
                        equal = (s[1:] == s[:-1]) & (m[1:] == m[:-1])
                flag = np.zeros(len(s), dtype=bool)
                flag[order[1:][equal]] = flag[order[:-1][equal]] = True
                hit = np.flatnonzero(flag)
            collect(owners, sizes, positions, hit)
        return pa.table({"doc": pa.array([f[0] for f in found], pa.int64()),
                         "th": pa.array([f[1] for f in found], pa.int64()),
                         "positions": pa.array([f[2] for f in found], pa.binary())})

    dealt = rows.select(*names).mapInArrow(deal, DEALT)
    return dealt.groupBy("part").applyInArrow(search, FOUND)


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The packed arrays of all rows as one."""
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind)
                           for chunk in column.chunks for x in chunk] or [np.zeros(0, kind)])


def by_document(found: DataFrame) -> DataFrame:
    """All positions of a document in one row: (doc, th, found array<binary>)."""
    return found.groupBy("doc", "th").agg(F.collect_list("positions").alias("found"))


def flags(found: Iterable[bytes] | None, n: int) -> np.ndarray:
    """Found positions as a mask over so many windows."""
    mask = np.zeros(max(n, 0), dtype=bool)
    for packed in found or ():
        mask[np.frombuffer(packed, dtype=np.uint32)] = True
    return mask
