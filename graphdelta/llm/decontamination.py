"""Benchmark decontamination: SimHash over item-sized windows, in DataFrame operations.

Every window that could match an item has a shingle of it, so shingles shared with
the benchmark say where windows are read: at the places where the item would have
to begin.  Each such window, as long as its item, gets a 64-bit SimHash of its
weighted shingles, as every item does.  A shingle's weight, how often the window has
it, enters as so many numbered occurrences: the weighted Jaccard similarity is then
that of two sets, and the angle between fingerprints follows it also where a phrase
is repeated.

A multi-index finds all pairs of fingerprints within the radius and is the only source
of pairs: cut into ``RADIUS + 1`` blocks, two fingerprints that differ in at most
``RADIUS`` bits agree in a block.  The pairs are verified by the exact weighted Jaccard
similarity of their shingles.  With ``radius=64`` every window meets every item of its
length: the exact path, against which recall is tested.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise
from graphdelta.llm.line_dedup import bound
from graphdelta.llm.repeats import keyed

WORDS = 5
PERCENT = 80
# At a similarity of 0.8 two sets lie at most 27 degrees apart and differ in about 10 of
# 64 bits, give or take 3; the radius lies over three deviations beyond, so of pairs
# right at the threshold some 0.03 % are missed and of closer ones fewer.
RADIUS = 20
BITS = 64
#: Bytes of the benchmark's side (shingles, index blocks) that may be broadcast, as
#: counted; a larger benchmark is joined by shuffles.
BROADCAST_BYTES = 64 << 20

WHITE = "[\\x20\\x09-\\x0D]+"


def word_list(text: Column) -> Column:
    """Lower-case words, parted by ASCII white space."""
    return F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")


def shingles(words: Column, size: Column) -> Column:
    """Hashes of all shingles, repeated ones included; fewer words are one shingle."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))),
                       lambda i: F.xxhash64(F.slice(words, i, size)))


def numbered(tokens: Column) -> Column:
    """Tokens in which repeated ones are told apart by their number, in no certain
    order: a set that stands for the counts."""
    def apart(inorder: Column) -> Column:
        def name(t: Column, i: Column) -> Column:
            nth = i + 1 - F.array_position(inorder, t)
            return F.when(nth == 0, t).otherwise(F.xxhash64(t, nth))
        return F.transform(inorder, name)
    return F.when(F.size(F.array_distinct(tokens)) == F.size(tokens), tokens).otherwise(
        bound(F.array_sort(tokens), apart))


def simhash(tokens: Column) -> Column:
    """Bit k is set if more tokens, counted with their weight, have it than not."""
    def votes(k: Column) -> Column:
        return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.call_function(
            "shiftright", t, k).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
                       lambda h, k: h.bitwiseOR(F.when(votes(k) > 0, F.call_function(
                           "shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: Column, radius: int) -> Column:
    """Array of (block, bits): ``radius`` + 1 blocks that share out all bits."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"),
                              (fingerprint if hi - lo == BITS else
                               F.shiftrightunsigned(fingerprint, lo).bitwiseAND(
                                   F.lit((1 << (hi - lo)) - 1))).alias("bits"))
                     for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))))


def small(df: DataFrame, width: Column | int) -> DataFrame:
    """Marked for broadcast if its bytes, counted as ``width`` a row, are within the bound."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS,
                 percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """(doc_id, doc, th, item_id, start, length, similarity): for every document and
    item that a window of it matches, the best such window (the first of equal
    ones), in words.

    A window has as many consecutive words as its item, or all words of a shorter
    document.  It matches if the weighted Jaccard similarity of its word shingles
    to the item's is at least ``percent`` / 100 and the fingerprints differ in at most
    ``radius`` bits (0 to 64; 64 is no condition).  Words are lower-cased.  Null and empty texts and items
    match nothing; items of fewer words are one shingle.  Items of equal text are
    told apart by id, repeated items count once, items without an id are left out.
    Rows equal in id and text have the same result each; an empty table on
    either side gives no rows.
    """
    if not 0 <= radius <= BITS:
        raise ValueError(f"radius {radius} is not in 0..{BITS}")
    rows = keyed(docs, id_col, text_col)
    items = materialise(
        benchmark.select(benchmark[item_col].cast("long").alias("item_id"),
                         word_list(F.coalesce(benchmark[item_text_col], F.lit(""))).alias("w"))
        .where("item_id is not null and size(w) > 0").dropDuplicates(["item_id", "w"])
        .select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(words)).alias("size"),
                shingles(F.col("w"), F.least(F.size("w"), F.lit(words))).alias("tokens"))
        .withColumn("set", numbered(F.col("tokens")))
        .withColumn("fingerprint", bound(F.col("set"), simhash)))
    seeds = small(items.select("item_id", "m", "size", F.posexplode("tokens").alias("j", "token")), 48)
    # at most `words` different shingle sizes, most often one
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [words]

    split = rows.select("doc", "th", word_list(F.col("text")).alias("w"))
    hits = None
    for size in sizes:
        at = split.where(F.size("w") >= size).select(
            "doc", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i")).select(
            "doc", "th", F.size("w").alias("n"), "i", F.lit(size).alias("size"),
            F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(size))).alias("token"))
        hits = at if hits is None else hits.union(at)
    # where the item would begin, moved into the document
    length = F.least("m", "n")
    windows = materialise(
        hits.join(seeds, ["token", "size"])
        .select("doc", "th", "m", "size", length.alias("length"),
                F.least(F.greatest(F.col("i") - F.col("j"), F.lit(0)), F.col("n") - length).alias("start"))
        .distinct())

    wanted = windows.groupBy("doc", "th").agg(
        F.collect_list(F.struct("m", "size", "length", "start")).alias("wanted"))
    read = (rows.select("doc", "th", "text").dropDuplicates(["doc", "th"]).join(wanted, ["doc", "th"])
            .select("doc", "th", word_list(F.col("text")).alias("w"), "wanted")
            .select("doc", "th", "w", F.explode("wanted").alias("s"))
            .select("doc", "th", "s.*", F.slice("w", F.col("s.start") + 1, F.col("s.length")).alias("w"))
            .withColumn("set", numbered(shingles(F.col("w"), F.col("size")))).drop("w")
            .withColumn("fingerprint", bound(F.col("set"), simhash)))
    found = materialise(read)
    index = small(items.select("item_id", "m", F.col("fingerprint").alias("item_fingerprint"),
                               F.explode(blocks(F.col("fingerprint"), radius)).alias("at"))
                  .select("item_id", "m", "item_fingerprint", "at.*"), 56)
    near = (found.select("doc", "th", "start", "m", "fingerprint",
                         F.explode(blocks(F.col("fingerprint"), radius)).alias("at"))
            .select("doc", "th", "start", "m", "fingerprint", "at.*")
            .join(index, ["m", "block", "bits"])
            .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
            .select("doc", "th", "start", "m", "item_id").distinct())
    held = small(items.select("item_id", F.col("set").alias("item_set")), 8 * F.size("item_set") + 32)
    checked = (near.join(found.select("doc", "th", "start", "m", "length", "set"),
                         ["doc", "th", "start", "m"])
               .join(held, "item_id")
               .withColumn("same", F.size(F.array_intersect("set", "item_set")))
               .withColumn("all", F.size("set") + F.size("item_set") - F.col("same"))
               .where(100 * F.col("same") >= percent * F.col("all")))
    best = checked.groupBy("doc", "th", "item_id").agg(F.max(F.struct(
        (F.col("same") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"),
        "length")).alias("best"))
    return (rows.select("doc_id", "doc", "th").join(best, ["doc", "th"])
            .select("doc_id", "doc", "th", "item_id", (-F.col("best.start")).alias("start"),
                    "best.length", "best.similarity"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"),
                        F.col("length").cast("long").alias("length"),
                        F.round("similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that match an item, all columns kept."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **params).select(
        "doc", "th").distinct()
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    doc = F.col(f"c{names.index(id_col)}").cast("long")
    marked = plain.withColumn("doc", F.coalesce(doc, F.lit(0))).withColumn("th", F.xxhash64(doc, text))
    return marked.join(bad, ["doc", "th"], "left_anti").select(
        *(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
