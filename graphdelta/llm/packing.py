"""Sum-of-squares packing of token streams into training sequences.

Each task streams its documents.  A document's tokens fill whole sequences as
long as they can; the rest, shorter than a sequence, goes into the fill level
that leaves the smallest sum of squared counts of partly filled sequences.  The
counts are held in an array with one entry for each level.

What stays partly filled at the end of a task (or beyond ``max_open`` open
sequences, which bounds memory) is cut anew into full sequences; the last of
them is cut at powers of two, which need no padding.
"""
from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphdelta.llm.common import id_text, slices

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
END_ID = 0
SEQUENCE_BITS = 36  # sequences a task can number


class Packer:
    """Packs one stream.  ``add`` returns the pieces that are settled by it,
    ``flush`` settles the rest.  A piece is (document, start, ids, tokens of the
    document, sequence, offset)."""

    def __init__(self, size: int, max_open: int, first_id: int = 0):
        self.size, self.max_open, self.next_id = size, max_open, first_id
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.levels = np.arange(size + 1)
        self.open: dict[int, list] = {}  # level -> sequences filled so far
        self.n_open = 0

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        size, n = self.size, len(ids)
        out = [(doc, s, ids[s:s + size], n, self._new(), 0) for s in range(0, n - size + 1, size)]
        rest = n % size
        if rest:
            out += self._place((doc, n - rest, ids[n - rest:], n), rest)
            if self.n_open > self.max_open:
                out += self.flush()
        return out

    def _place(self, piece: tuple, length: int) -> list[tuple]:
        level = self.best_level(length)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + length == self.size:
            return self._close(pieces)
        self.counts[level + length] += 1
        self.n_open += 1
        self.open.setdefault(level + length, []).append(pieces)
        return []

    def best_level(self, length: int) -> int:
        """The level (0: a new sequence) with the least sum of squares after the
        piece is put there; of equal ones the fullest."""
        n = self.counts
        fits = self.size - length
        change = 2 * n[length:self.size + 1] + 1  # the level it rises to
        change[fits] = 0  # a full sequence counts no longer
        change[1:] += 1 - 2 * n[1:fits + 1]  # the level it leaves
        change[1:][n[1:fits + 1] == 0] = np.iinfo(np.int64).max
        return fits - int(np.argmin(change[::-1]))

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, at, out = self._new(), 0, []
        for doc, start, ids, n in pieces:
            out.append((doc, start, ids, n, sequence, at))
            at += len(ids)
        return out

    def flush(self) -> list[tuple]:
        held = [p for level in sorted(self.open, reverse=True)
                for pieces in self.open[level] for p in pieces]
        left = sum(len(p[2]) for p in held)
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        out, current, room = [], [], 0
        for doc, start, ids, n in held:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) - at)
                current.append((doc, start + at, ids[at:at + take], n))
                at += take
                room -= take
                if not room:
                    out += self._close(current)
                    current = []
        return out


_encoders: dict[str | None, object] = {}


class Encoder:
    """Ids of a byte-level vocabulary given as a tokenizers .json.  Where the
    same vocabulary lies beside it as ranks, those give the same ids faster;
    texts with a special string go to the .json's own library."""

    def __init__(self, json_path: str | None):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(json_path: str | None = None) -> Encoder:
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(json_path)
    return _encoders[json_path]


def pack(docs: DataFrame, size: int = 1024, max_open: int = 4096,
         tokenizer_path: str | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens: (doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each document's ids, closed by id 0, lie in exactly one piece each.  Every
    sequence holds ``size`` tokens but the last few of a task, whose lengths are
    powers of two, so nothing is padded.  Null and empty texts are the end id
    alone; repeated rows and equal or null ids are packed as separate documents;
    no rows give no pieces.  One pass, no shuffle: a task holds one document and
    at most ``max_open`` open sequences.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        context = TaskContext.get()
        packer = Packer(size, max_open,
                        (context.partitionId() if context else 0) << SEQUENCE_BITS)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pieces], pa.int64()),
                 pa.array([p[1] for p in pieces], pa.int64()),
                 pa.array([len(p[2]) for p in pieces], pa.int64()),
                 pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
                 pa.array([p[3] for p in pieces], pa.int64()),
                 pa.array([p[4] for p in pieces], pa.int64()),
                 pa.array([p[5] for p in pieces], pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       "sequence_id", "offset"])

        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                out += packer.add(doc, np.array([*ids_of(text), END_ID], dtype="<u4"))
            if out:
                yield table(out)
        if out := packer.flush():
            yield table(out)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
