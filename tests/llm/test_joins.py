"""Operators on pairs and repeats against brute force: n-gram join, decontamination,
suffix array, substring and line dedup."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdelta.llm import decontamination, line_dedup, ngram_join, substring_dedup, suffix_dedup
from graphdelta.llm.components import connected_components
from graphdelta.llm.repeats import Block
from graphdelta.llm.textops import word_hashes, window_hashes


def words_of(text):
    return (text or "").encode().split()


def grams_of(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def roots(n, links):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x
    for a, b in links:
        p[max(f(a), f(b))] = min(f(a), f(b))
    return [f(x) for x in range(n)]


# hashing

def test_window_hashes_depend_on_the_words_alone():
    text = "Ab c  d\te\nAb c d é ab".encode()
    w = word_hashes(text)
    assert len(w) == len(text.split()) and w[0] == w[4] and w[0] != w[8]
    h = window_hashes(w, 3)
    assert len(h) == len(w) - 2 and h[0] == h[4] and len(set(h.tolist())) == len(h) - 1
    long = (b"word " * 300_000) + b"x" * 3_000_000 + b" end"
    assert len(word_hashes(long)) == 300_002 and word_hashes(long)[-1] == word_hashes(b"end")[0]
    assert len(word_hashes(b"")) == 0 and len(window_hashes(w, 99)) == 0


def test_block_sends_a_repeated_hash_once():
    block = Block(4, False)
    h = np.array([7, 7, 9, 7], dtype=np.uint64) << np.uint64(40)
    block.add(1, 11, np.arange(4, dtype=np.uint32) + 70_000, h, None)
    rows = block.rows().to_pylist()
    sent = sum(len(r["positions"]) // 2 for r in rows if not r["known"])
    known = sum(len(r["positions"]) // 2 for r in rows if r["known"])
    assert (sent, known) == (2, 3)


# components

@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)],
                                   [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)],
                                   [(9, 1), (8, 1), (8, 2), (7, 2), (7, 3), (20, 21)]])
def test_components(spark, links):
    got = dict(tuple(r) for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = roots(60, links)
    assert got == {x: want[x] for x in nodes}


# n-gram join

def brute_components(corpus):
    sets = [grams_of(t) for _, t in corpus]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(len(sets), links)
    least = defaultdict(list)
    for (i, _), r in zip(corpus, root):
        least[r].append(i)
    return sets, root, {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}


def test_near_duplicates_equal_brute_force(docs, corpus):
    sets, root, least = brute_components(corpus)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    want = Counter((i, len(s), least[r] if s else i) for (i, _), s, r in zip(corpus, sets, root))
    assert got == want


def test_one_document_of_each_component_stays(docs, corpus):
    sets, root, _ = brute_components(corpus)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    n_groups = len({r for s, r in zip(sets, root) if s})
    assert len(rows) == n_groups + sum(not s for s in sets)
    assert all(r.n == "x" for r in rows)
    by_text = defaultdict(set)
    for (_, t), s, r in zip(corpus, sets, root):
        by_text[t].add(r)
    assert sorted(x for r in rows if grams_of(r.text) for x in by_text[r.text]) == sorted(
        {r for s, r in zip(sets, root) if s})


def test_a_large_group_of_near_copies(spark):
    """Every two of 150 texts are near copies or copies of near copies: few pairs
    are proposed, no component is split."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        w = list(base)
        w[k % 100] = f"x{k}"
        if k % 3 == 0:
            w[(k * 7) % 100] = f"y{k}"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{i}" for i in range(40)), " ".join(base[:117])]
    corpus_ = list(enumerate(texts))
    frame = spark.createDataFrame(corpus_, "doc_id long, text string")
    sets, root, least = brute_components(corpus_)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()}
    assert got == {i: least[r] for (i, _), r in zip(corpus_, root)}


@pytest.mark.parametrize("block", [7, ngram_join.LINK_CLASSES])
def test_links_inside_a_component_equal_brute_force(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LINK_CLASSES", block)
    sets = {}
    for _, t in corpus:
        if grams_of(t):
            sets.setdefault(grams_of(t), len(sets))
    classes = list(sets)
    want = Counter()
    links = Counter()
    for i, s in enumerate(classes):
        for t in classes[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                want[s] += 1
                want[t] += 1
                links[len(s & t)] += 1
    got = Counter((r.doc_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect())
    assert got == Counter((i, want[grams_of(t)]) for i, t in corpus)
    pairs = ngram_join.near_links(docs).collect()
    assert Counter(r.same for r in pairs) == links
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) > len(classes) / 4


# decontamination

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two three"),
         (3, None), (4, "  "), (None, "no id here at all friends"), (5, "the the the the the the the the the the"),
         (6, " ".join(f"q{i}" for i in range(50))), (7, " ".join(f"q{i}" for i in range(50)))]
LEAKS = ["x y ALPHA beta gamma delta\nepsilon zeta eta theta iota kappa  lambda mu z", "one two three four",
         "three one two", "alpha beta gamma delta epsilon zeta nothing", "the the the the the the the the the",
         " ".join(f"q{i}" for i in range(1, 50)), "z " + " ".join(f"q{i}" if i != 9 else "r" for i in range(50)),
         " ".join(f"q{i}" if i != 25 else "r q25" for i in range(50)) + " t", "", None]


def brute_leaks(texts, items):
    found = {}
    for i, t in texts:
        w = (t or "").lower().split()
        for item, it in items:
            v = (it or "").lower().split()
            if item is None or not v or not w:
                continue
            k = min(5, len(v))
            # shingles of k words; a shorter document has none of this size
            v_sh = [tuple(v[j:j + k]) for j in range(len(v) - k + 1)]
            w_sh = [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]
            n = min(len(v), len(w))
            a = Counter(v_sh)
            starts = {min(max(x - y, 0), len(w) - n) for x, s in enumerate(w_sh) for y, u in enumerate(v_sh) if s == u}
            for s in sorted(starts):
                b = Counter(w_sh[s:s + n - k + 1])
                same, both = sum((a & b).values()), sum((a | b).values())
                if 100 * same >= 80 * both and same / both > found.get((i, item), (0,))[0]:
                    found[i, item] = (same / both, s)
    return found


def test_decontamination_equals_brute_force(spark, docs):
    texts = list(enumerate(LEAKS))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(a, b, "x", "y") for a, b in ITEMS],
                                  "item_id long, text string, token string, m string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start)
           for r in decontamination.contaminated(frame, items).collect()}
    assert got == brute_leaks(texts, ITEMS)
    assert (0, 1) in got and (6, 6) in got and (7, 7) in got
    kept = decontamination.drop_contaminated(frame.withColumn("th", F.lit("x")), items)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in got}
    assert kept.columns == ["doc_id", "text", "th"]


def test_a_changed_refrain_is_found(spark):
    """A word repeated fifty times and replaced: similarity 0.82.  Numbered occurrences
    keep the fingerprints within the radius."""
    items, texts = [], []
    for k in range(4):
        rest = [f"w{k}x{i}" for i in range(500)]
        items.append((k, " ".join(rest[:250] + [f"la{k}"] * 50 + rest[250:])))
        texts.append((k, "before " + " ".join(rest[:250] + [f"lo{k}"] * 50 + rest[250:]) + " after"))
    want = brute_leaks(texts, items)
    assert set(want) == {(k, k) for k in range(4)}
    got = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got.collect()} == want


def test_recall_of_the_index(spark):
    """Windows that lost or changed words, down to the threshold, some with refrains; the
    exact path meets every item of the window's length."""
    rnd = random.Random(11)
    items, texts = [], []
    for k in range(150):
        size = rnd.choice([6, 12, 25, 60, 120])
        words = [f"k{k}w{i}" if rnd.random() < 0.8 else f"k{k}la" for i in range(size)]
        items.append((k, " ".join(words)))
        for _ in range(3):
            changed = list(words)
            for _ in range(rnd.randint(0, max(1, size // 45))):
                changed[rnd.choice([0, size - 1, rnd.randrange(size)])] = f"new{rnd.random()}"
            texts.append((len(texts), " ".join([f"before{len(texts)}"] * 7 + changed + ["after"])))
    texts = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")

    def found(radius):
        return {(r.doc_id, r.item_id, r.start, r.similarity) for r in
                decontamination.contaminated(texts, items, radius=radius).collect()}
    exact, near, copies = found(64), found(decontamination.RADIUS), found(0)
    assert len(exact) > 250 and sum(r[3] < 0.85 for r in exact) > 10
    assert near <= exact and len(near) >= 0.99 * len(exact)
    assert {r for r in exact if r[3] == 1.0} <= copies <= exact
    with pytest.raises(ValueError):
        decontamination.contaminated(texts, items, radius=65)


def test_decontamination_of_repeated_rows_and_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = " ".join(["filler words go on"] * 30_000 + [item] + ["and on"] * 1000)
    rows = [(1, long), (1, long), (1, "another text"), (None, item), (2, item.upper()), (2, item.upper())]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"),
                                       spark.createDataFrame([(5, item), (5, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.start, r.similarity) for r in got.collect()), key=repr) == [
        (1, 5, 120_000, 1.0), (1, 5, 120_000, 1.0), (2, 5, 0, 1.0), (2, 5, 0, 1.0), (None, 5, 0, 1.0)]


def test_simhash_and_its_index(spark):
    """Bits by vote; fingerprints within the radius always share a block."""
    rng = np.random.default_rng(0)
    tokens = [[int(x) for x in rng.integers(-2**63, 2**63, 9)] for _ in range(5)]
    row = spark.createDataFrame([(t,) for t in tokens], "t array<long>").select(
        "t", decontamination.simhash(F.col("t")).alias("h")).collect()
    for r in row:
        for k in range(64):
            votes = sum(1 if (t >> k) & 1 else -1 for t in r.t)
            assert (r.h >> k) & 1 == (votes > 0)
    pairs = []
    for _ in range(200):
        a, flips = int(rng.integers(0, 2**63)), rng.choice(64, decontamination.RADIUS, replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        pairs.append((a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b))
    cut = spark.createDataFrame(pairs, "a long, b long").select(
        F.arrays_overlap(decontamination.blocks(F.col("a"), decontamination.RADIUS),
                         decontamination.blocks(F.col("b"), decontamination.RADIUS)).alias("ok"))
    assert cut.where("not ok").count() == 0


# repeats

def brute_windows(corpus, length):
    count, rows = Counter(), [words_of(t) for _, t in corpus]
    for w in rows:
        count.update(tuple(w[i:i + length]) for i in range(len(w) - length + 1))
    masks = []
    for w in rows:
        m = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                m[i:i + length] = [True] * length
        masks.append(m)
    return rows, masks


@pytest.mark.parametrize("start", [9, 35])
def test_substring_dedup_equals_brute_force(docs, corpus, start):
    rows, masks = brute_windows(corpus, 35)
    got = Counter(tuple(r) for r in substring_dedup.digest(
        substring_dedup.remove_repeats(docs, 35, start)).select(
            "doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = Counter((i, len(w), sum(m), hashlib.sha256(
        b" ".join(x for x, gone in zip(w, m) if not gone)).hexdigest())
        for (i, _), w, m in zip(corpus, rows, masks))
    assert got == want


def test_levels_double():
    assert substring_dedup.levels(35, 9) == [9, 18, 35]
    assert substring_dedup.levels(8, 9) == [8] and substring_dedup.levels(64, 1) == [1, 2, 4, 8, 16, 32, 64]


def test_suffix_dedup_equals_brute_force(docs, corpus):
    """Rows equal in id and text are one document here."""
    distinct = list(dict.fromkeys(corpus))
    rows, masks = brute_windows(distinct, 50)
    want = Counter()
    copies = Counter(corpus)
    for row, m in zip(distinct, masks):
        edges = np.flatnonzero(np.diff(np.r_[0, np.array(m, dtype=int), 0]))
        spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2]))
        want[row[0], sum(m), spans] += copies[row]
    got = Counter((r.doc_id, r.n_repeated, r.spans)
                  for r in suffix_dedup.digest(suffix_dedup.repeated_passages(docs, 50)).collect())
    assert got == want


@pytest.mark.parametrize("parts", [1, 4, 600])
def test_suffix_dedup_at_any_number_of_parts(spark, parts):
    """Groups of four texts that share 40 words, two of them ten more before these; with
    many parts most hold fewer suffixes than are compared, or none."""
    rnd = random.Random(8)
    words = iter("w%07d" % x for x in rnd.sample(range(10**7), 60_000))

    def take(n):
        return [next(words) for _ in range(n)]
    texts, want = [], {}
    for _ in range(80):
        shared, before = take(40), take(10)
        for k in range(4):
            doc = len(texts)
            texts.append((doc, " ".join(take(20) + (before if k < 2 else take(10)) + shared + take(20))))
            want[doc] = 50 if k < 2 else 0
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        got = suffix_dedup.digest(suffix_dedup.repeated_passages(frame, 50)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.doc_id: r.n_repeated for r in got} == want


def test_suffix_dedup_finds_partners_far_away_in_a_crowded_key(spark):
    """Pairs that share a few own words before a passage which stands in many
    documents, each of which goes on in its own way."""
    rnd = np.random.default_rng(4)
    passages = [[f"h{v}x{i}" for i in range(40)] for v in range(60)]
    # the one whose first words draw the minimisers away from the own ones
    hot = min(passages, key=lambda p: window_hashes(word_hashes(" ".join(p).encode()), 8, 1)[:6].min())
    texts = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(12)]
        for side in range(2):
            after = [f"a{k}y{side}z{i}r{rnd.integers(10**6)}" for i in range(30)]
            before = [f"b{k}y{side}z{i}r{rnd.integers(10**6)}" for i in range(30)]
            texts.append(" ".join(before + own + hot + after))
    rows, masks = brute_windows(list(enumerate(texts)), 50)
    want = {i: sum(m) for i, m in enumerate(masks)}
    assert set(want.values()) == {52}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.repeated_passages(frame, 50)).collect()
    assert {r.doc_id: r.n_repeated for r in got} == want


def test_minimisers_by_hand():
    words = word_hashes(b" ".join(f"{i % 37}x{i % 11}".encode() for i in range(300)))
    h = window_hashes(words, 8, 1)
    want = sorted({min(range(i, i + 16), key=lambda j: (h[j], j)) for i in range(len(h) - 15)})
    assert suffix_dedup.minimisers(words, 8, 16).tolist() == want
    assert len(suffix_dedup.minimisers(words[:22], 8, 16)) == 0
    assert len(suffix_dedup.minimisers(words[:23], 8, 16)) == 1


# lines

def brute_lines(corpus):
    """Removed line numbers for every distinct (id, text), ordered as the operator
    orders rows, which by id alone is only defined where ids differ."""
    lines, out = [], defaultdict(list)
    for i, t in corpus:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                w = line.split(" ")
                lines.append(((i, t), k, frozenset(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4)))))
    for n, (row, k, s) in enumerate(lines):
        if any(100 * len(s & e) >= 80 * len(s | e) for _, _, e in lines[:n]):
            out[row].append(k)
    return out


@pytest.fixture(scope="module")
def line_corpus(corpus):
    """Ids that order the rows; near copies of lines as well."""
    rows = [(i, t) for i, t in dict.fromkeys(corpus) if i is not None and t != "another text under an id that is taken"]
    base = [f"l{i}" for i in range(60)]
    near = []
    for k in range(30):
        w = list(base)
        w[k] = f"m{k}"
        if k % 2:
            w[(k * 11) % 60] = f"n{k}"
        near.append((1000 + k, f"{' '.join(w)}\nown line {k} of this text here\nshort {k}\nshort"))
    return rows + near + [(2000, "\n  \nshort\n"), (2001, "short"), (2002, " ".join(base) + "\n\nnew words at the end")]


def test_line_dedup_equals_brute_force(spark, line_corpus):
    want = brute_lines(sorted(line_corpus, key=lambda r: r[0]))
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in line_corpus],
                                  "doc_id long, text string, line string, removed string")
    got = {r.doc_id: r for r in line_dedup.digest(line_dedup.repeated_lines(frame)).collect()}
    for i, t in line_corpus:
        assert got[i].removed == ",".join(map(str, want.get((i, t), []))), (i, t)
        assert got[i].n_lines == len((t or "").split("\n"))
    kept = line_dedup.drop_repeated_lines(frame)
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    for i, t in line_corpus:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in want.get((i, t), [])]
        if not want.get((i, t)):
            assert texts[i] == t
        elif any(x.strip() for x in left):
            assert texts[i] == "\n".join(left)
        else:
            assert i not in texts


def test_line_dedup_with_repeated_rows(docs, corpus):
    got = line_dedup.repeated_lines(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in corpus)


@pytest.mark.parametrize("common", [2, 8, 1000])
def test_line_dedup_with_frequent_shingles(spark, monkeypatch, common):
    """Lines that share a passage, some of them near copies of each other, where what
    is frequent makes no pairs, and where it does."""
    monkeypatch.setattr(line_dedup, "COMMON", common)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, "\n".join(f"{' '.join(f'u{i}x{j}x{k}' for k in range(20))} {passage}" for j in range(3)))
            for i in range(12)]
    rows += [(20 + i, f"{passage} " + " ".join(f"v{k if k != i else 90 + i}" for k in range(40))) for i in range(9)]
    rows += [(40 + i, f"{passage} e{i}") for i in range(5)] + [(50, "e1"), (51, None)]
    want = brute_lines(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.repeated_lines(frame).collect()}
    assert sum(map(len, want.values())) > 10
    assert {i: got[i].removed for i, _ in rows} == {(i): want.get((i, t), []) for i, t in rows}
    assert {i: got[i].n_lines for i, _ in rows} == {i: len((t or "").split("\n")) for i, t in rows}


def test_line_dedup_pairs_need_common_prefixes(spark):
    """One shared shingle makes no pair where the prefixes show too little in common."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    texts = [a, [*a[:12], *b[12:]], [*a[:59], "z"]]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    classes = line_dedup.classes_of(line_dedup.lines_of(line_dedup.keyed(frame)), 5, 80)
    rooms = line_dedup.dealt(classes.select("h1", "n", F.posexplode("prefix").alias("pos", "token")), "h1")
    shared = rooms.join(line_dedup.shared_tokens(rooms, "h1", 80), "token")
    doc = {r.h1: r.place.doc for r in classes.collect()}
    pairs = line_dedup.close_pairs(shared, classes, 80).collect()
    assert [sorted((doc[r.x], doc[r.y])) for r in pairs] == [[0, 2]]


# empty tables

def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert ngram_join.drop_near_duplicates(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.repeated_passages(no_docs).count() == 0
    assert line_dedup.repeated_lines(no_docs).count() == 0
    assert line_dedup.drop_repeated_lines(no_docs).columns == no_docs.columns
    assert decontamination.contaminated(no_docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontamination.contaminated(one, items.where("false")).count() == 0
    assert decontamination.drop_contaminated(one, items.where("false")).count() == 1
