"""Fill-in-middle transformation.

A text is cut into units by one match of ``(unit)*`` against all of it: the regex
library keeps every repetition of a captured group, so ``match.ends(1)`` gives the
number of units and the place of any cut without a loop over them.  What the cuts
and the form are is drawn from the SHA-256 of ``seed:doc_id``.

Forms: ``plain`` is the text as it is; ``psm`` is ``<P>`` prefix ``<S>`` suffix
``<M>`` middle; ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.  A text that
is empty or holds one of the marks stays plain, so a mark found in an output is
always one that was put there and ``restored`` is exact.

Defined results: a null text is empty; a null id is drawn as an empty one; repeated
rows give repeated results; an empty table gives none; other columns are not read.
A text that is no sequence of units (possible with a unit of one's own) stays plain
with ``n`` null.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import id_text, slices

MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
# The regex library holds some hundred bytes a repetition and refuses a match beyond
# its own memory limit; a longer text is matched in consecutive runs of so many units.
UNITS_PER_MATCH = 1_000_000

COLUMNS = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the digest, as unsigned integers."""
    text = f"{seed}:" + ("" if doc_id is None else str(doc_id))
    hexed = hashlib.sha256(text.encode()).hexdigest()
    return [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str, one: regex.Pattern, run: regex.Pattern) -> list[int] | None:
    """Where each unit ends; None if the text is no sequence of units."""
    if len(text) <= UNITS_PER_MATCH:
        found = one.fullmatch(text)
        return None if found is None else found.ends(1)
    ends: list[int] = []
    while (at := ends[-1] if ends else 0) < len(text):
        found = run.match(text, at)
        if found is None or found.end() == at:
            return None
        ends += found.ends(1)
    return ends


def transform(text: str, drawn: list[int], ends: list[int] | None, plain_from: int,
              spm_below: int) -> tuple[int | None, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of a text."""
    n = None if ends is None else len(ends)
    if not n or any(mark in text for mark in MARKS) or drawn[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    lo, hi = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = ends[lo - 1] if lo else 0, ends[hi - 1] if hi else 0
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm_below:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1,
                   plain_from: int = 90, spm_below: int = 20,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every text.

    ``unit``: pattern of one unit, without groups of its own: a code point, ``\\X``
    for a grapheme, ``[^\\n]*\\n|[^\\n]+`` for a line.  ``n`` counts units; the two
    lengths are code points, null where the form is plain.
    """
    one, many = f"({unit})*", f"({unit}){{1,{UNITS_PER_MATCH}}}+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part = regex.compile(one), regex.compile(many)
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [transform(t, draws(seed, i), unit_ends(t, whole, part), plain_from, spm_below)
                    for i, t in zip(ids, b.column("text").to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_text(docs, id_col, text_col).mapInArrow(run, COLUMNS)


def restored(form: Column, output: Column) -> Column:
    """The text rebuilt from an output and its form."""
    parts = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
             .otherwise(output))


def digest(transformed: DataFrame) -> DataFrame:
    """The transformation with its texts hashed."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
