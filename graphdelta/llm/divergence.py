"""Source divergence audit: how far the word use of each source of a language lies
from every other source's, and which terms set it apart from its language.

Late string materialization.  Terms are counted under 64-bit digests: what is shuffled
for the counts is language, source and digest, never a term.  Once the kept digests are
known (in enough documents of a language), a second reading of the texts gives the
smallest and the largest string of each; where the two differ, several terms share the
digest, and only those are counted again by their strings.  A digest that is not kept
needs no such look, since the terms under it are in fewer documents still.  Texts of
terms are joined back to the few rows that are put out.

Within a task digests are counted in arrays of fixed-width rows; the hash of a text's
terms is worked out for all of them at once.

``value`` compares two smoothed shares in billionths, all in whole numbers:
``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))``, ``f = floor((p - q)^2 / (p + q))``.
Two groups are compared over all kept terms of the language in cells of terms by
sources: a task holds the counts of some terms in at most two tiles of sources, and
what leaves it is one sum for each two sources.

Defined results: a null text, language or source is ''.  Rows are counted as they are,
repeated ones too.  A group without terms has count 0 everywhere; a language that keeps
no term has value 0 for all pairs and no term rows.  A language with one source has no
pairs.  An empty table gives no rows; other columns, whatever their names, are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise, slices
from graphdelta.llm.textops import span_hashes

# Runs of letters A-Z, a-z and of all characters beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
PIECE = 1 << 20
TILE = 128  # sources in a tile
ROWS_PER_CELL = 200_000
SLICE = 1 << 20  # bytes of text hashed at a time
HELD = 2_000_000  # counted digests a task holds before it hands them on
# Terms, as strings, that a task holds, and the text it reads before it hands them on.
SPELLED, SPELLED_BYTES = 600_000, 256 << 20
SALTS = 32

_IN_TERM = np.array([chr(x).isalpha() and x < 128 or x >= 128 for x in range(256)])

COUNTS = "lang string, source string, digest long, n long, docs long"


def _pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Cuts of a long text, made between terms."""
    lo = 0
    while len(raw) - lo > 2 * PIECE:
        gap = GAP.search(raw, lo + PIECE)
        if gap is None:
            break
        yield lo, gap.start()
        lo = gap.start()
    yield lo, len(raw)


def _terms(raw: bytes) -> Iterator[list[bytes]]:
    return (TERM.findall(raw, lo, hi) for lo, hi in _pieces(raw))


def _digests(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of a lower-case text starts and its digest, a signed number of
    ``bits`` bits."""
    starts, out = [], []
    for lo, hi in _pieces(raw):
        b = np.frombuffer(raw, dtype=np.uint8, count=hi - lo, offset=lo)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = _IN_TERM[b]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        starts.append(start + lo)
        out.append(span_hashes(b, start, end) >> np.uint64(64 - bits))
    return np.concatenate(starts), np.concatenate(out).view(np.int64)


def _summed(group: np.ndarray, digest: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal group and digest added up, in order of both."""
    order = np.argsort(digest)
    small = group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group
    order = order[np.argsort(small[order], kind="stable")]
    group, digest = group[order], digest[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])]
                           [:len(group)])
    return group[first], digest[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)


def _counter(bits: int):
    """Counts digests by group: ``n`` occurrences in ``docs`` documents.  What a task
    holds is arrays of fixed-width rows, merged as they grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def out():
            group, digest, n, docs = merged()
            lang, source = (pa.array(x, pa.string()) for x in zip(*groups))
            for lo in range(0, len(group), 200_000):
                at = pa.array(group[lo:lo + 200_000])
                yield pa.RecordBatch.from_arrays(
                    [lang.take(at), source.take(at), *(pa.array(x[lo:lo + 200_000]) for x in (digest, n, docs))],
                    names=["lang", "source", "digest", "n", "docs"])

        for b in slices(batches, size=SLICE):
            raws = [t.encode().lower() for t in b.column("text").to_pylist()]  # of bytes: A-Z alone
            ends = np.cumsum([len(r) + 1 for r in raws])
            start, digest = _digests(b"\n".join(raws), bits)
            if not len(start):
                continue
            doc, digest, n = _summed(np.searchsorted(ends, start, side="right"), digest,
                                     np.ones(len(start), dtype=np.int64))
            group = np.array([groups.setdefault(g, len(groups)) for g in
                              zip(b.column("lang").to_pylist(), b.column("source").to_pylist())])
            held.append((group[doc], digest, n, np.ones(len(doc), dtype=np.int64)))
            size += len(doc)
            if size > 2 * HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD:
                    yield from out()
                    groups, held, size = {}, [], 0
        if held:
            yield from out()

    return run


def _strings(terms: list[bytes], bits: int) -> tuple[pa.Array, pa.Array]:
    """Digests of terms, and the terms."""
    return pa.array(_digests(b"\n".join(terms), bits)[1]), pa.array(terms, pa.binary())


def _speller(bits: int):
    """Distinct terms of each language, ``(lang, digest, term)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[bytes]] = {}

        def out():
            for lang, terms in seen.items():
                terms = list(terms)
                for lo in range(0, len(terms), 50_000):
                    digest, term = _strings(terms[lo:lo + 50_000], bits)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), digest, term],
                                                     names=["lang", "digest", "term"])

        read = 0
        for b in slices(batches, size=SLICE):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                seen.setdefault(lang, set()).update(*_terms("\n".join(texts).encode().lower()))
            entries = sum(map(len, seen.values()))
            read += b.nbytes
            if entries > SPELLED or read > SPELLED_BYTES:
                yield from out()
                seen, read = {}, 0
        yield from out()

    return run


def _split_counter(bits: int):
    """Counts as ``_counter`` gives them, by the terms themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE):
            groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                distinct: set[bytes] = set()
                for found in _terms(text.encode().lower()):
                    counts.update(found)
                    distinct.update(found)
                docs.update(distinct)
            for (lang, source), (counts, docs) in groups.items():
                if counts:
                    digest, term = _strings(list(counts), bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(term), pa.string()), pa.array([source] * len(term), pa.string()),
                         digest, pa.array(counts.values(), pa.int64()),
                         pa.array([docs[t] for t in counts], pa.int64()), term],
                        names=["lang", "source", "digest", "n", "docs", "term"])

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1e9 * (count + 2) / (total + 2 * terms))`` in whole numbers, three
    digits at a time, so that nothing leaves 64 bits below 9e15 occurrences."""
    div = total + 2 * terms
    whole, rest = _divided(count + 2, div)
    for _ in range(3):
        more, rest = _divided(rest * 1000, div)
        whole = whole * 1000 + more
    return whole + 1


def _divided(a: Column, b: Column) -> tuple[Column, Column]:
    return F.call_function("div", a, b), a % b


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; p and q are at most 1e9 + 1, so it stays in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``share`` for arrays."""
    div = total + 2 * terms
    whole, rest = np.divmod(n + 2, div)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, div)
        whole = whole * 1000 + more
    return whole + 1


def _cell(key, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of ``f`` over the terms of a cell for each two sources of its tiles."""
    lang, _, tile_a, tile_b = (k.as_py() for k in key)
    names, tiles = sources.column("source").to_pylist(), np.asarray(sources.column("tile"))
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names, tiles = [names[i] for i in order], tiles[order]
    totals = np.asarray(sources.column("total"))[order]
    number = {s: i for i, s in enumerate(names)}
    first, second = np.flatnonzero(tiles == tile_a), np.flatnonzero(tiles == tile_b)
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    terms, unseen = (int(sources.column(c)[0].as_py()) for c in ("terms", "in_block"))
    if counts.num_rows:
        codes = counts.column("term_key").combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        column = np.asarray(codes.indices).astype(np.int64)
        width = int(column.max()) + 1
        unseen -= width
        source = np.array([number[s] for s in counts.column("source").to_pylist()])
        n = np.asarray(counts.column("n"))
        by_term = np.argsort(column, kind="stable")
        column, source, n = column[by_term], source[by_term], n[by_term]
        step = max(1, (1 << 21) // max(1, len(names)))
        for lo in range(0, width, step):  # some terms at a time, all sources
            a, b = np.searchsorted(column, (lo, lo + step))
            held = np.zeros((len(names), min(step, width - lo)), dtype=np.int64)
            held[source[a:b], column[a:b] - lo] = n[a:b]
            p = _shares(held, totals[:, None], terms)
            for i in first:
                others = second[second > i] if tile_a == tile_b else second
                for part in range(0, len(others), 16):
                    j = others[part:part + 16]
                    off = p[j] - p[i]
                    sums[i, j] += (off * off // (p[j] + p[i])).sum(axis=1)
    if unseen:  # terms of the block that only sources of other tiles have
        p = _shares(np.zeros(len(names), dtype=np.int64), totals, terms)
        off = p[:, None] - p
        sums += unseen * (off * off // (p[:, None] + p))
    i, j = np.meshgrid(first, second, indexing="ij")
    use = i < j if tile_a == tile_b else np.ones_like(i, dtype=bool)
    i, j = i[use], j[use]
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()),
                     "a": pa.array([names[x] for x in i], pa.string()),
                     "b": pa.array([names[x] for x in j], pa.string()),
                     "value": pa.array(sums[i, j], pa.int64())})


def term_counts(docs: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, spelling)``: kept terms' counts ``(lang, source, digest, split, n)`` by
    group, and ``(lang, digest, split, term)``.  ``split`` tells the terms of a shared
    digest apart and is empty elsewhere."""
    by_digest = materialise(
        docs.mapInArrow(_counter(bits), COUNTS)
            .groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    frequent = materialise(by_digest.groupBy("lang", "digest").agg(F.sum("docs").alias("docs"))
                                    .filter(F.col("docs") >= least_docs).select("lang", "digest"))
    ends = materialise(
        docs.mapInArrow(_speller(bits), "lang string, digest long, term binary")
            .join(frequent, ["lang", "digest"], "left_semi")
            .groupBy("lang", "digest").agg(F.min("term").alias("least"), F.max("term").alias("most")))
    shared = F.col("least") != F.col("most")
    empty = F.lit(b"")
    kept = (by_digest.join(ends.filter(~shared).select("lang", "digest"), ["lang", "digest"])
                     .select("lang", "source", "digest", empty.alias("split"), "n"))
    spelling = ends.filter(~shared).select("lang", "digest", empty.alias("split"), F.col("least").alias("term"))
    if not ends.filter(shared).isEmpty():
        apart = materialise(
            docs.mapInArrow(_split_counter(bits), COUNTS + ", term binary")
                .join(ends.filter(shared).select("lang", "digest"), ["lang", "digest"], "left_semi")
                .groupBy("lang", "source", "digest", F.col("term").alias("split"))
                .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        enough = (apart.groupBy("lang", "digest", "split").agg(F.sum("docs").alias("docs"))
                       .filter(F.col("docs") >= least_docs).select("lang", "digest", "split"))
        kept = kept.unionByName(apart.join(enough, ["lang", "digest", "split"], "left_semi")
                                     .select("lang", "source", "digest", "split", "n"))
        spelling = spelling.unionByName(enough.withColumn("term", F.col("split")))
    return materialise(kept), spelling


def source_divergence(table: DataFrame, least_docs: int = 10, top_terms: int = 10, bits: int = 64,
                      tile: int = TILE, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` ranks the other sources
    of the language by their distance, part ``term`` the terms that the group uses more
    than its language does.  ``bits``: width of the digests; results don't depend on it."""
    docs = table.select(*[F.coalesce(table[c].cast("string"), F.lit("")).alias(a) for c, a in
                          ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept, spelling = term_counts(docs, least_docs, bits)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = spelling.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = materialise(
        docs.select("lang", "source").distinct()
            .join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
            .na.fill(0, ["total", "terms"]))

    # pairs of sources
    n_sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_rows = kept.count()
    tiles = max(1, -(-n_sources // tile))
    blocks = max(1, -(-2 * n_rows // (tiles * ROWS_PER_CELL)))
    of_source = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    of_term = F.pmod(F.xxhash64("digest", "split"), F.lit(blocks)).cast("int")
    all_tiles = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    sides = [F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b")]
    cell = ["lang", "block", "tile_a", "tile_b"]
    counts = (kept.withColumn("tile", of_source).withColumn("block", of_term).select("*", all_tiles)
                  .select(*cell[:2], *sides, "source", "n",
                          F.concat(F.col("digest").cast("string").cast("binary"), F.lit(b":"), "split")
                           .alias("term_key")))
    in_block = spelling.groupBy("lang", of_term.alias("block")).agg(F.count(F.lit(1)).alias("in_block"))
    placed = (groups.withColumn("tile", of_source)
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                    .join(in_block, ["lang", "block"], "left").na.fill(0, ["in_block"]).select("*", all_tiles)
                    .select(*cell[:2], *sides, "source", "tile", "total", "terms", "in_block"))
    sums = (counts.groupBy(*cell).cogroup(placed.groupBy(*cell))
                  .applyInArrow(_cell, "lang string, a string, b string, value long")
                  .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (sums.select("lang", ways, "value")
                 .select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
                 .withColumn("rank", F.row_number().over(order)))

    # terms of a group
    key = ["lang", "digest", "split"]
    whole = (kept.groupBy(*key).agg(F.sum("n").alias("in_lang")))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    sized = (groups.join(of_lang, "lang")
                   .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("digest", "split"), F.lit(SALTS)).cast("int")
    valued = materialise(
        kept.withColumn("salt", salt).join(sized, ["lang", "source", "salt"]).join(whole, key)
            .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
            .withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("terms")))
            .filter(F.col("p") > F.col("q"))
            .select("lang", "source", "salt", "digest", "split", distance(F.col("p"), F.col("q")).alias("value")))
    # the lowest value that can be among the first, then the texts of no other rows
    some = Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "digest", "split")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    lowest = (valued.withColumn("at", F.row_number().over(some)).filter(F.col("at") <= top_terms)
                    .withColumn("at", F.row_number().over(first)).filter(F.col("at") <= top_terms)
                    .groupBy("lang", "source").agg(F.min("value").alias("lowest"))
                    .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    within = Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item")
    terms = (valued.join(lowest, ["lang", "source", "salt"]).filter(F.col("value") >= F.col("lowest"))
                   .join(spelling, key)
                   .select("lang", "source", "salt", F.lit("term").alias("part"),
                           F.col("term").cast("string").alias("item"), "value")
                   .withColumn("at", F.row_number().over(within)).filter(F.col("at") <= top_terms)
                   .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
                   .select("lang", "source", "part", "item", "value", "rank"))
    return pairs.unionByName(terms)
