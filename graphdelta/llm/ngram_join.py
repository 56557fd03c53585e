"""Similarity join of documents on their word n-grams.

A document is the set of its distinct n-grams.  Documents of equal sets are one
class.  Of two sets that overlap enough, the rarest few n-grams of each must have
one in common, so only these prefixes are joined (after length, positional and
suffix filters), and every pair found is verified once.

N-grams that only one class has can't be shared; they count for the size of a set
and its prefix, but are dropped as soon as their frequency is known.

Groups of near copies would give a pair for every two members.  For components
that isn't needed: each prefix n-gram first proposes pairs with two of its members
only; after that, pairs are proposed between different components alone.  No link
leads out of a component, so for the links themselves every two classes of a
component are compared afterwards, block by block, without a row for a pair.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise, release, slices
from graphdelta.llm.components import connected_components
from graphdelta.llm.repeats import in_order, joined, keyed, part_of, parts_for
from graphdelta.llm.textops import shingle_set, word_hashes

WORDS = 5
PERCENT = 80
#: At most 2 * 2**FREQUENT_BITS n-grams can be frequent: each makes up at least
#: half of that share of all n-grams.  They are known beforehand (8 bytes each).
FREQUENT_BITS = 18
COUNT_ENTRIES = 2_000_000  # n-grams a task holds while it counts
BLOCK_ENTRIES = 400_000
MAPS = 16  # words of 64 bits, for the suffix filter
ROUNDS = 3  # of proposing pairs with a few members of an n-gram's list
#: Classes, and n-grams of them, in a block of a component whose links are counted.
LINK_CLASSES = 256
LINK_ENTRIES = 400_000

_LOW48 = np.uint64((1 << 48) - 1)


def ngram_set(text: str, words: int = WORDS) -> np.ndarray:
    return shingle_set(word_hashes(text.encode("utf-8", "surrogatepass").lower()), words)


def class_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.md5(grams.tobytes()).digest()


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set linked to it."""
    return -(-percent * size // 100)


def profile(rows: DataFrame, words: int) -> DataFrame:
    """One pass: (doc_id, doc, th, key, n) for every row, and, as rows without
    key, n-grams that a task has seen often, with their counts."""
    schema = "doc_id long, doc long, th long, key binary, n long, gram long, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def often():
            nonlocal held, n_held
            grams = np.sort(np.concatenate(held))
            edges = np.r_[0, np.flatnonzero(grams[1:] != grams[:-1]) + 1, len(grams)]
            count = np.diff(edges)
            least = max(4, -(-n_held >> FREQUENT_BITS))
            at = np.flatnonzero(count >= least)
            held, n_held = [], 0
            none = pa.nulls(len(at))
            return pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()),
                 none.cast(pa.binary()), none.cast(pa.int64()),
                 pa.array(grams[edges[:-1][at]].view(np.int64)), pa.array(count[at])], names=names)

        names = [c.split()[0] for c in schema.split(", ")]
        for b in slices(batches):
            keys, sizes = [], []
            for t in b.column("text").to_pylist():
                grams = ngram_set(t, words)
                keys.append(class_key(grams))
                sizes.append(len(grams))
                if len(grams):
                    held.append(grams)
                    n_held += len(grams)
                if n_held >= COUNT_ENTRIES:
                    yield often()
            none = pa.nulls(len(keys)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("doc"), b.column("th"), pa.array(keys, pa.binary()),
                 pa.array(sizes, pa.int64()), none, none], names=names)
        if held:
            yield often()

    return rows.select("doc_id", "doc", "th", "text").mapInArrow(run, schema)


def frequent(profiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams and their order, the rarer first (bounded, see above)."""
    total = profiles.agg(F.sum("n")).first()[0] or 0
    least = max(4, total >> FREQUENT_BITS)
    got = (profiles.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen"))
           .where(F.col("seen") >= least).collect())
    got.sort(key=lambda r: (r.seen, r.gram))
    grams = np.array([r.gram for r in got], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], order.astype(np.int64)


def shared_grams(rows: DataFrame, words: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n, grams, ranks): for each class parts of the n-grams that other
    classes have too, with a rank that grows with their frequency."""
    parts = parts_for(rows)
    known = rows.sparkSession.sparkContext.broadcast(hot)
    dealt_schema = "part int, frequent boolean, owners binary, sizes binary, grams binary"
    names = [c.split()[0] for c in dealt_schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams, hot_rank = known.value
        block, held, seen = [], 0, set()

        def send():
            nonlocal block, held
            owners = np.array([o for o, _, _ in block], dtype="V20")
            out = []
            for is_hot in (False, True):
                grams = [g[1 + is_hot] for g in block]
                sizes = np.array([len(g) for g in grams])
                owner = np.repeat(np.arange(len(block)), sizes)
                grams = np.concatenate(grams)
                if is_hot:  # by class: of copies one goes on
                    part = np.array([int.from_bytes(o[:4], "little") % parts for o, _, _ in block],
                                    dtype=np.int64)[owner]
                else:
                    part = part_of(grams, parts)
                order = in_order(part, parts)
                part = part[order]
                edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if hi > lo:
                        mine = owner[order[lo:hi]]
                        starts = np.r_[0, np.flatnonzero(np.diff(mine)) + 1, len(mine)]
                        g = grams[order[lo:hi]]
                        out.append((int(part[lo]), is_hot, owners[mine[starts[:-1]]].tobytes(),
                                    np.diff(starts).astype(np.uint32).tobytes(),
                                    g.astype(np.uint32).tobytes() if is_hot else
                                    g.view(np.uint16).reshape(-1, 4)[:, :3].tobytes()))
            block, held = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary(),
                                                            pa.binary(), pa.binary()))], names=names)

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                grams = ngram_set(t, words)
                key = class_key(grams)
                if not len(grams) or key in seen:
                    continue
                seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                at = np.searchsorted(hot_grams, grams)
                hit = (hot_grams[np.minimum(at, len(hot_grams) - 1)] == grams
                       if len(hot_grams) else np.zeros(len(grams), dtype=bool))
                block.append((key + len(grams).to_bytes(4, "little"), grams[~hit], hot_rank[at[hit]]))
                held += len(grams)
                if held >= BLOCK_ENTRIES:
                    yield send()
        if block:
            yield send()

    def search(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        out = []
        for is_hot in (False, True):
            t = table.filter(pc.equal(table["frequent"], is_hot))
            if not t.num_rows:
                continue
            owners, sizes = joined(t["owners"], "V20"), joined(t["sizes"], np.uint32)
            halves = owners.view("<u8, <u8, <u4")
            order = np.lexsort((halves["f1"], halves["f0"]))
            a, b = halves["f0"][order], halves["f1"][order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            once = np.zeros(len(owners), dtype=bool)  # of copies one counts
            once[order[first]] = True
            entry = np.repeat(once, sizes)
            owner = np.repeat(np.arange(len(owners)), sizes)[entry]
            if is_hot:
                ranks = joined(t["grams"], np.uint32)[entry].astype(np.int64)
                # frequent ones come after all others, and stand for themselves
                ids, ranks = -1 - ranks, ranks + (1 << 40)
            else:
                packed = np.zeros((len(entry), 4), dtype=np.uint16)
                packed[:, :3] = joined(t["grams"], np.uint16).reshape(-1, 3)
                grams = packed.view(np.uint64).ravel()[entry]
                order = np.argsort(grams)
                s = grams[order]
                edges = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)] if len(s) else np.zeros(1, int)
                count = np.diff(edges)
                df = np.empty(len(s), dtype=np.int64)
                df[order] = np.repeat(count, count)
                keep = np.flatnonzero(df > 1)
                owner, ranks = owner[keep], df[keep]
                ids = grams[keep].astype(np.int64) | (part % (1 << 15) << 48)
            if not len(owner):
                continue
            edges = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
            who = owners[owner[edges[:-1]]].tobytes()
            offsets = pa.array(edges, pa.int32())
            out.append(pa.table({
                "key": pa.array([who[i:i + 16] for i in range(0, len(who), 20)], pa.binary()),
                "n": pa.array(halves["f2"][owner[edges[:-1]]].astype(np.int64)),
                "grams": pa.ListArray.from_arrays(offsets, pa.array(ids)),
                "ranks": pa.ListArray.from_arrays(offsets, pa.array(ranks))}))
        empty = pa.schema([("key", pa.binary()), ("n", pa.int64()),
                           ("grams", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))]).empty_table()
        return pa.concat_tables(out or [empty])

    return (rows.select("text").mapInArrow(deal, dealt_schema).groupBy("part")
            .applyInArrow(search, "key binary, n long, grams array<long>, ranks array<long>"))


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(key, n, grams, first, n_prefix, maps) of the classes that can be linked:
    shared n-grams by rarity, the place of the first of them in the whole order,
    how many of them lie in the prefix, and a bitmap of them."""
    schema = "key binary, n long, grams array<long>, first long, n_prefix long, maps array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                grams = np.concatenate([np.array(g, dtype=np.int64) for g in r["grams"]])
                ranks = np.concatenate([np.array(g, dtype=np.int64) for g in r["ranks"]])
                n, first = r["n"], r["n"] - len(grams)
                n_prefix = n - needed(n, percent) + 1 - first
                if n_prefix <= 0:
                    continue
                grams = grams[np.lexsort((grams, ranks))]
                bits = np.zeros(MAPS * 64, dtype=np.uint8)
                bits[grams & (MAPS * 64 - 1)] = 1
                out.append({"key": r["key"], "n": n, "grams": grams, "first": first,
                            "n_prefix": min(n_prefix, len(grams)),
                            "maps": np.packbits(bits).view(np.int64)})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(
                    [("key", pa.binary()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())),
                     ("first", pa.int64()), ("n_prefix", pa.int64()),
                     ("maps", pa.list_(pa.int64()))]))

    whole = shared.groupBy("key").agg(F.first("n").alias("n"), F.collect_list("grams").alias("grams"),
                                      F.collect_list("ranks").alias("ranks"))
    return whole.mapInArrow(run, schema)


def may_link(x: str, y: str, percent: int, suffix: bool = False) -> Column:
    """Length and positional filter on two postings of one n-gram and, if wanted,
    the suffix filter: a bit that only one set has stands for an n-gram that the
    other lacks, wherever it is, so what is left of its shared n-grams bounds the
    overlap."""
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def at_most(one: str, other: str) -> Column:
        lacking = sum((F.bit_count(F.get(c(one, "maps"), k).bitwiseAND(
            F.bitwise_not(F.get(c(other, "maps"), k)))) for k in range(MAPS)), F.lit(0))
        return c(one, "n") - c(one, "first") - lacking
    least = F.ceil(percent * (c(x, "n") + c(y, "n")) / F.lit(100 + percent))
    rest = 1 + F.least(c(x, "n") - c(x, "pos") - 1, c(y, "n") - c(y, "pos") - 1)
    may = ((100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n")))
           & (rest >= least))
    return may & (at_most(x, y) >= least) & (at_most(y, x) >= least) if suffix else may


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough; each is compared once."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"),
                           F.col("grams").alias(f"grams_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    return (both.withColumn("same", same)
            .where(100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same")))
            .select("a", "b"))


def ordered_pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def mixed(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with the component so far (``root``), of the n-grams that more than
    one component has."""
    if found is None:
        at = postings.withColumn("root", F.col("key"))
    else:
        at = postings.join(found, F.col("key") == F.col("node"), "left").select(
            *postings.columns, F.coalesce("root", "key").alias("root"))
    several = at.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return materialise(at.join(several.where("lo <> hi").select("gram"), "gram"))


def star_pairs(at: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of every posting with two of its n-gram's, other ones each turn."""
    one, by = F.struct("key", "root", "n", "pos"), F.xxhash64("key", F.lit(turn))
    centres = at.groupBy("gram").agg(F.min_by(one, by).alias("lo"), F.max_by(one, by).alias("hi"))
    sides = []
    for end in ("lo", "hi"):
        other = centres.select("gram", F.col(f"{end}.*")).alias("y")
        sides.append(at.alias("x").join(other, F.col("x.gram") == F.col("y.gram"))
                     .where((F.col("x.root") != F.col("y.root")) & may_link("x", "y", percent))
                     .select(*ordered_pair(F.col("x.key"), F.col("y.key"))))
    return sides[0].union(sides[1]).distinct()


def all_pairs(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of postings of one n-gram in different components that pass all
    filters, which are part of the joins: what they reject is never a row.

    Components with several postings of an n-gram are joined as wholes first, so
    that their own members, which need no comparing, don't meet.
    """
    size = at.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
    at = materialise(at.join(size, ["gram", "root"]).join(sets.select("key", "first", "maps"), "key"))
    alone, several = at.where("c = 1"), at.where("c > 1")
    may = may_link("x", "y", percent, suffix=True)
    same = F.col("x.gram") == F.col("y.gram")
    # one posting each: the smaller root is x, so every pair comes once
    out = [alone.alias("x").join(alone.alias("y"), same & (F.col("x.root") < F.col("y.root")) & may),
           alone.alias("x").join(several.alias("y"), same & may)]
    groups = several.select("gram", "root").distinct()
    met = (groups.alias("g").join(groups.alias("h"), "gram").where(F.col("g.root") < F.col("h.root"))
           .select("gram", F.col("g.root").alias("root"), F.col("h.root").alias("met")))
    out.append(several.join(met, ["gram", "root"]).alias("x").join(
        several.alias("y"), same & (F.col("x.met") == F.col("y.root")) & may))
    ends = [o.select(*ordered_pair(F.col("x.key"), F.col("y.key"))) for o in out]
    return ends[0].union(ends[1]).union(ends[2]).distinct()


def class_components(rows: DataFrame, profiles: DataFrame, words: int,
                     percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) over classes that are linked with another, and the classes' sets."""
    spark = rows.sparkSession
    sets = materialise(prefixes(shared_grams(rows, words, frequent(profiles)), percent))
    release(spark)
    postings = sets.select(
        F.posexplode(F.slice("grams", F.lit(1), F.col("n_prefix").cast("int"))).alias("i", "gram"),
        "key", "n", "first").select("gram", "key", "n", (F.col("first") + F.col("i")).alias("pos"))
    tried = links = found = None
    at = mixed(postings, None)
    for turn in range(ROUNDS):
        pairs = star_pairs(at, turn, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        new = materialise(verified(pairs, sets, percent))
        tried = pairs if tried is None else tried.union(pairs)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        found = materialise(connected_components(links))
        at = mixed(postings, found)
    release(spark)
    # what is left: pairs of classes in different components, each but once
    rest = all_pairs(at, sets, percent).join(tried, ["a", "b"], "left_anti")
    more = materialise(verified(rest, sets, percent))
    if found is None:
        return connected_components(more), sets
    if more.isEmpty():
        return found, sets
    return connected_components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), sets


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets of either side share."""
    known, at = np.unique(np.concatenate(left), return_inverse=True)
    owner = np.repeat(np.arange(len(left)), [len(g) for g in left])
    order = np.argsort(at, kind="stable")
    owner, edges = owner[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(known)))]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for j, grams in enumerate(right):
        k = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        k = k[known[k] == grams]
        size = edges[k + 1] - edges[k]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[:, j] = np.bincount(owner[np.repeat(edges[k], size) + step], minlength=len(left))
    return out


def linked_blocks(found: DataFrame, sets: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """All links within components: the pairs (a, b, same) or, for each class of a
    pair of blocks, how many classes it is linked with: (key, n_links).

    Every two blocks of a component meet once, so a set is sent once for each block
    of its component.
    """
    at = materialise(sets.join(found, F.col("key") == F.col("node")).select("key", "root", "n", "grams"))
    size = at.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(LINK_CLASSES)),
        F.ceil(F.sum(F.size("grams")) / F.lit(LINK_ENTRIES))).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (at.join(size, "root").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "root", "n", "grams", "block", F.least("block", "other").alias("lo"),
                     F.greatest("block", "other").alias("hi")))
    schema = "a binary, b binary, same long" if pairs else "key binary, n_links long"

    def compare(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        keys = table["key"].to_pylist()
        n = table["n"].to_numpy()
        grams = [np.array(g, dtype=np.int64) for g in table["grams"].to_pylist()]
        block = table["block"].to_numpy()
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if not len(x) or not len(y):
            i = j = same = np.zeros(0, dtype=np.int64)
        else:
            same = overlaps([grams[k] for k in x], [grams[k] for k in y])
            hit = 100 * same >= percent * (n[x][:, None] + n[y][None, :] - same)
            if lo == hi:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            same, i, j = same[i, j], x[i], y[j]
        if not pairs:
            count = np.bincount(np.r_[i, j], minlength=len(keys))
            return pa.table({"key": pa.array(keys, pa.binary()), "n_links": pa.array(count, pa.int64())})
        ends = [sorted((keys[k], keys[m])) for k, m in zip(i, j)]
        return pa.table({"a": pa.array([e[0] for e in ends], pa.binary()),
                         "b": pa.array([e[1] for e in ends], pa.binary()),
                         "same": pa.array(same, pa.int64())})

    return dealt.groupBy("root", "lo", "hi").applyInArrow(compare, schema)


def near_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between classes, each once: (a, b, same), ``same`` the n-grams that
    both have.  ``key`` of ``near_duplicates`` tells which rows are in a class; rows
    of one class are copies and no link of their own."""
    _, found, sets = _classes(docs, words, percent, id_col, text_col)
    return linked_blocks(found, sets, percent, pairs=True)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of at
    least ``percent`` / 100: (doc_id, doc, th, n_shingles, component_id, root, key,
    n_links).

    Words are lower-cased (A-Z) runs of characters other than ASCII white space;
    a text of fewer words is one n-gram of all of them.  ``component_id`` is the
    smallest id reachable by links, itself included.  One row for each input row,
    repeated rows included.  Null, empty and blank texts have no n-grams and are
    linked with nothing, not even each other.  Null ids take part, but are no
    smallest id unless a component has no other.  (doc, th) tell rows apart as in
    ``repeats.keyed``; ``root`` names the component and ``key`` the class, null
    without n-grams; ``n_links`` is the number of other classes that the class is
    linked with.  N-grams are compared by 48 bits and more of hash within a
    pair, sets of equal classes by 128.
    """
    profiles, linked, sets = _classes(docs, words, percent, id_col, text_col)
    links = linked_blocks(linked, sets, percent, pairs=False).groupBy("key").agg(
        F.sum("n_links").alias("n_links"))
    grouped = _grouped(profiles, linked)
    return grouped.join(materialise(links), "key", "left").select(
        "doc_id", "doc", "th", "n_shingles", "component_id", "root", "key",
        F.when(F.col("root").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0)))
        .cast("long").alias("n_links"))


def _classes(docs: DataFrame, words: int, percent: int, id_col: str,
             text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = keyed(docs, id_col, text_col)
    profiles = materialise(profile(rows, words))
    return profiles, *class_components(rows, profiles, words, percent)


def _grouped(profiles: DataFrame, linked: DataFrame) -> DataFrame:
    filled = profiles.where("n > 0")
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("least"))
    at = (classes.join(linked, F.col("key") == F.col("node"), "left")
          .select("key", "least", F.coalesce("root", "key").alias("root")))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = at.join(least, "root").select("key", "root", "component_id")
    columns = ["doc_id", "doc", "th", F.col("n").alias("n_shingles"), "component_id", "root", "key"]
    alone = profiles.where("n = 0").withColumn("key", F.lit(None).cast("binary")).select(
        "*", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root"))
    return filled.join(labels, "key").select(*columns).union(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns kept: the one of the smallest id
    (of equal ids the smallest row hash; a null id counts as 0).  Of repeated rows
    one stays.  Documents without words are linked with nothing and all stay."""
    profiles, linked, _ = _classes(docs, words, percent, id_col, text_col)
    grouped = _grouped(profiles, linked).where("root is not null")
    chosen = grouped.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("one")).select("one.*")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    has_words = F.rlike(text, F.lit("[^\\x20\\x09-\\x0D]"))
    doc = F.col(f"c{names.index(id_col)}").cast("long")
    marked = plain.where(has_words).withColumn("doc", F.coalesce(doc, F.lit(0))).withColumn(
        "th", F.xxhash64(doc, text))
    kept = marked.join(chosen, ["doc", "th"]).dropDuplicates(["doc", "th"]).select(*plain.columns)
    return kept.union(plain.where(~has_words)).toDF(*names)
