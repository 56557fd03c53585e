"""Token counts without identifiers: byte-pair merging on a heap and a linked list.

The text is cut where no vocabulary piece can reach across, so every segment is
counted once and remembered.  A merge joins the adjacent pair whose joined piece
has the lowest rank (ties: leftmost); the number of tokens is the number of
initial symbols minus the number of merges.  A character that no piece covers
stands for its UTF-8 bytes and never merges.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphdelta.llm.common import id_text, slices

SPACE = "▁"  # fixed value: the model's mark for a space
CACHE_ENTRIES = 250_000  # a task's remembered segments; only time depends on it

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Remembered(dict):
    """Counts of strings seen lately; emptied when full."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = n = self.count(key)
        return n


class MergeCounter:
    """Counts tokens under ranked pieces (piece -> rank, lower merges first)."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        # pairs of characters that stand side by side in some piece: a merge can
        # only ever reach across such a pair
        self.joinable = {p[i:i + 2] for p in ranks for i in range(len(p) - 1)}
        self.words = Remembered(self._word)
        self.segments = Remembered(self.merged)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        # words are told apart at the spaces only if no piece has a space inside
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in ranks)

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self._word(marked)
        return sum(map(self.words.__getitem__, self.split(marked)))

    def _word(self, word: str) -> int:
        joinable, total, lo = self.joinable, 0, 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in joinable:
                total += self.segments[word[lo:i]]
                lo = i
        return total + self.segments[word[lo:]]

    def merged(self, segment: str) -> int:
        """Symbols of one segment after all merges."""
        ranks = self.ranks
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        initial = sum(1 if c in ranks else len(c.encode("utf-8", "surrogatepass"))
                      for c in segment)
        if n == 1:
            return initial
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            rank = ranks.get(piece)
            if rank is not None:
                heapq.heappush(heap, (rank, i, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != piece:
                continue  # one side has merged since
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return initial - merges


_counters: dict[str | None, MergeCounter] = {}


def counter(model_path: str | None = None) -> MergeCounter:
    """The counter of a .model file, loaded once in a Python worker.  Control,
    unknown and byte entries are no pieces of text."""
    if model_path not in _counters:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(
            model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        ids = [i for i in range(sp.get_piece_size())
               if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids.sort(key=lambda i: (-sp.get_score(i), i))
        _counters[model_path] = MergeCounter({sp.id_to_piece(i): r for r, i in enumerate(ids)})
    return _counters[model_path]


def token_counts(docs: DataFrame, limit: int = 4096, model_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: (doc_id, n_bytes, n_tokens, over_limit).

    One row for each input row, repeated rows included, in one pass without a
    shuffle.  Null and empty texts have 0 bytes and 0 tokens; a null id stays
    null.  Whole texts are counted, however long.  ``model_path`` names the
    vocabulary file on the executors; by default the installed
    ``piece_bpe_32k.model``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model_path).text
        for b in slices(batches):
            texts = b.column("text")
            tokens = [of(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"),
                 pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()),
                 pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)
