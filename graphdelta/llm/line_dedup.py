"""Line deduplication by an exact set-similarity join, in DataFrame operations.

A line is the set of its distinct word shingles.  Equal lines are one class, and
only classes are joined.  The shingles of a line have an order; of two lines that
overlap enough, the first few of each order have one in common, so the join is on
these prefixes, with length, positional and bitmap filters, and what passes is
verified.  A line goes if an earlier one matches it.

Any order common to all lines keeps the join exact.  The first prefixes are by hash.
Pairs that share a shingle of few prefixes are made at once, and the prefixes say how
much the two can have in common.  Lines with a shingle of many prefixes are joined
among themselves: by second prefixes, in which what is frequent there comes last.
Texts are read again only for lines that are left in either.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise, release
from graphdelta.llm.repeats import keyed

WORDS = 5
PERCENT = 80
COMMON = 256  # shingles in more prefixes or lines than this are frequent
COMMON_LIST = 1 << 14  # of them the most frequent ones come last in the order
BITMAPS = 4  # of 64 bits each

# what tells lines apart and orders them
PLACE = ("doc", "th", "line")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lines_of(rows: DataFrame) -> DataFrame:
    """(doc, th, line, content) of all lines that have a word."""
    return (rows.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("line", "content"))
            .where(F.rlike("content", F.lit("[^\\x20\\x09-\\x0D]"))))


def shingles(content: Column, words: int) -> Column:
    """64-bit hashes of a line's shingles; a shorter line is one shingle: words beyond
    the line's end are null, which the hash passes over."""
    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    return bound(F.split(content, " "), of)


def tokens_of(content: Column, words: int) -> Column:
    """Distinct shingles in the order of their hashes."""
    return F.sort_array(F.array_distinct(shingles(content, words)))


def prefix_size(percent: int) -> Column:
    return F.expr(f"n - cast(({percent} * n + 99) div 100 as int) + 1")


def classes_of(lines: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for each distinct line: both hashes, its first place, how often it
    occurs, its number of shingles and its prefix."""
    hashed = lines.select(
        *PLACE, F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"),
        tokens_of(F.col("content"), words).alias("tokens"))
    shown = hashed.select(*PLACE, "h1", "h2", F.size("tokens").alias("n"), "tokens").select(
        F.struct(*PLACE).alias("place"), "h1", "h2", "n",
        F.slice("tokens", F.lit(1), prefix_size(percent)).alias("prefix"))
    return shown.groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def dealt(postings: DataFrame, line: str) -> DataFrame:
    """(token, line, room): length and what is left of it from the token on, in one
    number."""
    n = F.col("n")
    return postings.select("token", line, F.shiftleft(n.cast("long"), 32).bitwiseOR(
        (n - F.col("pos")).cast("long")).alias("room"))


def length(room: str) -> Column:
    return F.shiftright(room, 32)


def left(room: str) -> Column:
    return F.col(room).bitwiseAND(F.lit((1 << 32) - 1))


def may_share(x: str, y: str, percent: int) -> Column:
    """Length and positional filter on two rooms of a token."""
    n, m = length(x), length(y)
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (F.least(left(x), left(y)) >= least_overlap(n, m, percent)))


def shared_tokens(rooms: DataFrame, line: str, percent: int) -> DataFrame:
    """(token, c) of the tokens in two lines or more.  Where there are just two,
    they pass the length and positional filters."""
    counts = rooms.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.min("room").alias("lo"), F.max("room").alias("hi"),
        F.min(line).alias("one"), F.max(line).alias("other"))
    return (counts.where((F.col("c") > 1) & (F.col("one") != F.col("other"))
                         & ((F.col("c") > 2) | may_share("lo", "hi", percent))).select("token", "c"))


def close_pairs(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, y): hashes of lines that share a token which is not frequent and whose
    prefixes have as much in common as a match needs."""
    few = shared.where(F.col("c") <= COMMON)
    x, y = (few.select("token", F.col("h1").alias(end), F.col("room").alias(f"room_{end}")) for end in "xy")
    pairs = (x.join(y, "token").where(F.col("x") < F.col("y")).where(may_share("room_x", "room_y", percent))
             .select("x", "y").distinct())

    def side(end: str) -> DataFrame:
        return classes.select(F.col("h1").alias(end), F.col("n").alias(f"n_{end}"),
                              F.col("prefix").alias(f"prefix_{end}"))
    both = side("x").join(pairs.hint("shuffle_hash"), "x")
    both = side("y").join(both.hint("shuffle_hash"), "y")
    # beyond the prefix that ends first, all the rest of its line may be in common
    rest = {end: F.col(f"n_{end}") - F.size(f"prefix_{end}") for end in "xy"}
    ends = {end: F.element_at(f"prefix_{end}", -1) for end in "xy"}
    most = (F.size(F.array_intersect("prefix_x", "prefix_y"))
            + F.when(ends["x"] < ends["y"], rest["x"]).when(ends["x"] > ends["y"], rest["y"])
            .otherwise(F.least(rest["x"], rest["y"])))
    return both.where(most >= least_overlap(F.col("n_x"), F.col("n_y"), percent)).select("x", "y").distinct()


def contents_of(rows: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """(place, n, tokens, hot) of the lines at these (place, hot)."""
    wanted = places.select("place.*", "hot").groupBy("doc", "th").agg(
        F.collect_set("line").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("line"))).alias("hots"))
    # equal rows are one document
    lines = (rows.select("doc", "th", "text").join(wanted, ["doc", "th"]).dropDuplicates(["doc", "th"])
             .select("doc", "th", "wanted", "hots", F.posexplode(F.split("text", "\n")).alias("line", "content"))
             .where(F.array_contains("wanted", F.col("line"))))
    tokens = lines.select(F.struct(*PLACE).alias("place"), tokens_of(F.col("content"), words).alias("tokens"),
                          F.array_contains("hots", F.col("line")).alias("hot"))
    return tokens.select("place", F.size("tokens").alias("n"), "tokens", "hot")


def bitmaps_of(contents: DataFrame) -> DataFrame:
    """(place, map0..): 64 bits each, one for each shingle whose hash falls into the
    k-th map."""
    t = F.col("token")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    mine = F.shiftrightunsigned(t, 6).bitwiseAND(F.lit(BITMAPS - 1))
    maps = [f"map{k}" for k in range(BITMAPS)]
    return (contents.select("place.*", F.explode("tokens").alias("token")).groupBy(*PLACE)
            .agg(*(F.bit_or(F.when(mine == k, bit).otherwise(F.lit(0).cast("long"))).alias(m)
                   for k, m in enumerate(maps)))
            .select(F.struct(*PLACE).alias("place"), *maps))


def common_tokens(contents: DataFrame) -> list[int]:
    """The shingles in more than ``COMMON`` of these lines, a bounded list."""
    often = (contents.select(F.explode("tokens").alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > COMMON))
    return [r["token"] for r in often.orderBy(F.desc("often"), "token").limit(COMMON_LIST).collect()]


def rare_first(contents: DataFrame, common: list[int], percent: int) -> DataFrame:
    """(place, n, pos, token): prefixes by hash, with the common ones last."""
    tokens = F.col("tokens")
    if common:
        tokens = F.concat(F.filter(tokens, lambda t: ~t.isin(common)), F.filter(tokens, lambda t: t.isin(common)))
    first = contents.select("place", "n", tokens.alias("tokens"))
    return first.select("place", "n", F.posexplode(
        F.slice("tokens", F.lit(1), prefix_size(percent))).alias("pos", "token"))


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def may_match(x: str, y: str, percent: int) -> Column:
    """Length, positional and bitmap filter on two postings of a shingle: a bit that
    only one line has stands for a shingle that the other lacks."""
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def lacking(one: str, other: str) -> Column:
        return sum((F.bit_count(c(one, f"map{k}").bitwiseAND(F.bitwise_not(c(other, f"map{k}"))))
                    for k in range(BITMAPS)), F.lit(0))
    n, m = c(x, "n"), c(y, "n")
    least = least_overlap(n, m, percent)
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (1 + F.least(n - c(x, "pos") - 1, m - c(y, "pos") - 1) >= least)
            & (n - lacking(x, y) >= least) & (m - lacking(y, x) >= least))


def verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Pairs (later, earlier) whose shingles overlap enough."""
    def side(name: str) -> DataFrame:
        return contents.select(F.col("place").alias(name), F.col("n").alias(f"n_{name}"),
                               F.col("tokens").alias(f"tokens_{name}"))
    both = pairs.join(side("later"), "later").join(side("earlier"), "earlier")
    same = F.size(F.array_intersect("tokens_later", "tokens_earlier"))
    return (both.withColumn("same", same)
            .where(100 * F.col("same") >= percent * (F.col("n_later") + F.col("n_earlier") - F.col("same")))
            .select("later", "earlier"))


def matched_places(rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(place) of the classes that an earlier, different class matches."""
    spark = rows.sparkSession
    # one exchange for the counts and the join
    rooms = dealt(classes.select("h1", "n", F.posexplode("prefix").alias("pos", "token")),
                  "h1").repartition("token")
    shared = materialise(rooms.join(shared_tokens(rooms, "h1", percent).hint("shuffle_hash"), "token"))
    release(spark)
    pairs = materialise(close_pairs(shared, classes, percent))
    able = (pairs.select(F.explode(F.array("x", "y")).alias("h1"), F.lit(False).alias("hot"))
            .union(shared.where(F.col("c") > COMMON).select("h1", F.lit(True).alias("hot")))
            .groupBy("h1").agg(F.max("hot").alias("hot")))
    # two classes of equal hash are both taken
    places = materialise(classes.select("h1", "place", "copies").join(able.hint("shuffle_hash"), "h1"))
    contents = materialise(contents_of(rows, places, words))
    release(spark)
    x, y = (places.select(F.col("h1").alias(end), F.col("place").alias(f"place_{end}")) for end in "xy")
    close = (pairs.join(x, "x").join(y, "y").where(F.col("place_x") != F.col("place_y"))
             .select(F.greatest("place_x", "place_y").alias("later"),
                     F.least("place_x", "place_y").alias("earlier")))
    matched = materialise(verified(close, contents, percent).select("later").distinct())
    hot = contents.where("hot").drop("hot")
    if not hot.isEmpty():
        matched = matched.union(matched_among(hot, places, matched, percent)).distinct()
    return matched.withColumnRenamed("later", "place")


def matched_among(contents: DataFrame, places: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(later) of these lines that an earlier one of them matches; those known to
    match any line may be missing."""
    postings = materialise(rare_first(contents, common_tokens(contents), percent))
    maps = [f"map{k}" for k in range(BITMAPS)]
    lines = places.where("hot").select("place", "copies").join(bitmaps_of(contents), "place")
    several = shared_tokens(dealt(postings, "place"), "place", percent).select("token")
    at = materialise(postings.join(several, "token").join(lines, "place")
                     .select("token", "place", "copies", "n", "pos", *maps))
    release(contents.sparkSession)
    one = F.struct("place", "n", "pos", *maps)
    # most lines that match any match the first of their shingle or the most copied
    likely = at.groupBy("token").agg(F.min_by(one, "place").alias("first"),
                                     F.max_by(one, F.struct("copies", "place")).alias("hub"))
    open_ = at.join(known, F.col("place") == F.col("later"), "left_anti")
    tried = None
    for end in ("first", "hub"):
        y = likely.select("token", F.col(f"{end}.*")).alias("y")
        pairs = (open_.alias("x").join(y, F.col("x.token") == F.col("y.token"))
                 .where(F.col("y.place") < F.col("x.place")).where(may_match("x", "y", percent))
                 .select(F.col("x.place").alias("later"), F.col("y.place").alias("earlier")))
        tried = pairs if tried is None else tried.union(pairs)
    tried = materialise(tried.distinct())
    matched = materialise(verified(tried, contents, percent).select("later").distinct())
    open_ = open_.join(matched, F.col("place") == F.col("later"), "left_anti")
    rest = (open_.alias("x").join(at.alias("y"), F.col("x.token") == F.col("y.token"))
            .where(F.col("y.place") < F.col("x.place")).where(may_match("x", "y", percent))
            .select(F.col("x.place").alias("later"), F.col("y.place").alias("earlier")).distinct()
            .join(tried, ["later", "earlier"], "left_anti"))
    return matched.union(verified(rest, contents, percent).select("later"))


def repeated_lines(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, th, n_lines, removed): for every row the numbers, from 0, of
    the lines that match an earlier line, in order.

    Lines are what line feeds part; words what single spaces part, compared as they
    are.  Lines match if the Jaccard similarity of their word shingles (a line of
    fewer words is one shingle) is at least ``percent`` / 100; earlier is by id,
    row and line number, whether that line stays or not.  Lines without a word
    match nothing.  Null texts are empty: one line without words.  Rows equal in id and
    text are one document and have the same result; null ids are ordered as 0.
    """
    rows = keyed(docs, id_col, text_col)
    lines = lines_of(rows)
    classes = materialise(classes_of(lines, words, percent))
    release(rows.sparkSession)
    matched = materialise(matched_places(rows, classes, words, percent))
    repeated = (classes.join(matched.withColumn("again", F.lit(True)), "place", "left")
                .where("copies > 1 or again").select("h1", "h2", "place", "again"))
    gone = (lines.select(F.struct(*PLACE).alias("at"), F.xxhash64("content").alias("h1"),
                         F.xxhash64(F.lit(1), "content").alias("h2"))
            .join(repeated.hint("shuffle_hash"), ["h1", "h2"]).where("again or at <> place").select("at.*"))
    removed = gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return (rows.select("doc_id", "doc", "th", (feeds + 1).alias("n_lines"))
            .join(removed, ["doc", "th"], "left")
            .select("doc_id", "doc", "th", "n_lines",
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def digest(repeated: DataFrame) -> DataFrame:
    return repeated.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts, all columns kept.
    A document that had words and has none left goes: all it said is said before.
    The others stay, also those without text."""
    lines = repeated_lines(docs, words, percent, id_col, text_col).where(F.size("removed") > 0)
    names = docs.columns
    # positions, not names, so that no column of docs can clash
    key = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, doc = F.col(f"c{names.index(text_col)}"), F.col(f"c{names.index(id_col)}").cast("long")
    marked = key.withColumn("doc", F.coalesce(doc, F.lit(0))).withColumn(
        "th", F.xxhash64(doc, F.coalesce(text, F.lit(""))))
    joined = marked.join(lines.select("doc", "th", "removed").dropDuplicates(["doc", "th"]),
                         ["doc", "th"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    out = joined.withColumn("kept", F.when(F.col("removed").isNull(), text).otherwise(kept)).where(
        "removed is null or rlike(kept, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return out.select(*(F.col("kept" if n == text_col else f"c{i}").alias(n)
                        for i, n in enumerate(names)))
