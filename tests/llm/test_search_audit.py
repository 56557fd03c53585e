"""Ops 11, 12 and 13 against plain rules worked out row by row."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdelta.llm import divergence, fill_in_middle, topk_search


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- op 11 ---------------------------------------------------------------------------

def plain_fill_in_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not n or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha("<S>" + s + "<P>" + p + "<M>" + m), sha(text)
    return doc_id, n, "psm", a, b - a, sha("<P>" + p + "<S>" + s + "<M>" + m), sha(text)


def test_fill_in_middle(spark, docs, corpus):
    odd = [(900 + i, t) for i, t in enumerate(
        ["<", "a<P>b", "ends with <S", "<M", "<<S<P", "<M><S>", "é́\r\n😀" * 5, "\n", "\x00x", "P>" * 9] * 4)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted(map(tuple, fill_in_middle.digest(fill_in_middle.fill_in_middle(table)).collect()), key=repr)
    assert got == sorted((plain_fill_in_middle(*r) for r in corpus + odd), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_reads_no_other_column(docs, no_docs):
    named = docs.withColumn("output", F.lit(1)).withColumn("form", F.lit("x"))
    a, b = (sorted(map(tuple, fill_in_middle.fill_in_middle(d).collect()), key=repr) for d in (docs, named))
    assert a == b
    assert fill_in_middle.digest(fill_in_middle.fill_in_middle(no_docs)).collect() == []


def test_long_texts_are_matched_in_runs(monkeypatch):
    import regex
    whole, part = regex.compile(r"((?s:.))*"), regex.compile(r"((?s:.)){1,7}+")
    monkeypatch.setattr(fill_in_middle, "UNITS_PER_MATCH", 7)
    for n in (0, 1, 6, 7, 8, 14, 50):
        text = ("aé\n" * n)[:n]
        assert fill_in_middle.unit_ends(text, whole, part) == list(range(1, n + 1))
    letters = regex.compile("([a-z])*"), regex.compile("([a-z]){1,7}+")
    assert fill_in_middle.unit_ends("abc", *letters) == [1, 2, 3]
    assert fill_in_middle.unit_ends("abcdefgh9ijk", *letters) is None
    assert fill_in_middle.unit_ends("9", *letters) is None


def test_a_long_text_beyond_one_match(spark):
    text = "xyé\n" * 800_000
    row = fill_in_middle.digest(fill_in_middle.fill_in_middle(
        spark.createDataFrame([(3, text)], "doc_id long, text string"))).first()
    assert tuple(row) == plain_fill_in_middle(3, text)


def test_units_of_ones_own(spark):
    texts = [(i, "one\ntwo\n\nthree" * (i % 3 + 1)) for i in range(40)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = fill_in_middle.fill_in_middle(table, unit=r"[^\n]*\n|[^\n]+", plain_from=100)
    for r in rows.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect():
        text = texts[r.doc_id][1]
        ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        assert r.n == len(ends) and r.back == text and r.form != "plain"
        assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, *ends}
    refused = fill_in_middle.fill_in_middle(table, unit="[a-z]").select("n", "form").distinct().collect()
    assert [tuple(r) for r in refused] == [(None, "plain")]


# --- op 12 ---------------------------------------------------------------------------

def plain_top_k(rows, k, scale=64):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(float(x) * scale) for x in v]
    use = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    out = []
    for at, (qid, q) in enumerate(use):
        if qid is None or qid % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), cid is None, cid or 0)
                  for other, (cid, c) in enumerate(use) if other != at]
        for rank, (score, null, cid) in enumerate(sorted(scored)[:k], 1):
            out.append((qid, rank, None if null else cid, max(min(-score, 2**63 - 1), -2**63)))
    return sorted(out, key=repr)


def found(df, k=20):
    hits = topk_search.top_k(df, df["vec_id"] % 20 == 0, k=k)
    assert hits.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, hits.collect()), key=repr)


VECTORS = "vec_id long, embedding array<double>, block int, score string, n string, rank long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 7, "x", "y", 1) for i, v in rows], VECTORS).repartition(parts)


def clustered(n, d, seed, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, d))
    x = centres[rnd.integers(0, 9, n)] + spread * rnd.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("d, parts", [(64, 1), (40, 5), (3, 2)])
def test_top_k(spark, d, parts):
    rows = list(enumerate(clustered(300, d, d)))
    assert found(table(spark, rows, parts)) == plain_top_k(rows, 20)


def test_top_k_odd_rows(spark):
    rnd = random.Random(5)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(rnd.choice([0, 2, 4, 6]))]) for i in range(-40, 60)]
    rows += [(i, same) for i in range(100, 190)]  # many ties, a third of the rows and more
    rows += [(120, same), (120, same), (120, [1.0]), (140, [0.0] * 4), (140, [0.0] * 4)]
    rows += [(None, same), (None, [9.0, 9.0]), (160, None), (180, [1.0, None]), (200, [math.nan]),
             (220, [math.inf, 1.0]), (221, [-math.inf])]
    assert found(table(spark, rows)) == plain_top_k(rows, 20)
    assert found(table(spark, rows), k=3) == plain_top_k(rows, 3)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e7, 1e30])
def test_top_k_large_components(spark, size):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(20)]) for i in range(45)]
    got, want = found(table(spark, rows), k=4), plain_top_k(rows, 4)
    if size < 1e30:
        assert got == want
    else:  # scores beyond 64 bits are all the last long of their side
        assert [r[0] for r in got] == [r[0] for r in want] and {abs(r[3]) >= 2**63 - 1 for r in got} == {True}


def test_top_k_few_or_no_rows(spark):
    few = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [0.1, 0.1])]
    assert found(table(spark, few)) == plain_top_k(few, 20)
    assert found(table(spark, [(20, [1.0])])) == []
    assert found(table(spark, [(1, [1.0]), (2, [1.0])])) == []
    assert found(spark.createDataFrame([], VECTORS)) == []


def test_top_k_in_passes(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "PASS_BYTES", 2000)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk_search, "CAND_ROWS", 17)
    monkeypatch.setattr(topk_search, "SAMPLE_ROWS", 10)
    rows = list(enumerate(clustered(400, 24, 2)))
    assert found(table(spark, rows, 4)) == plain_top_k(rows, 20)


def test_search_block_misses_no_pair():
    rnd = np.random.default_rng(0)
    for trial in range(30):
        d, m, n = rnd.integers(1, 70), rnd.integers(1, 40), rnd.integers(1, 200)
        top = [5, 60, 3000, 2**20][trial % 4]
        q = rnd.integers(-top, top, (d, m)) * (rnd.random((d, 1)) < 0.7)
        c = rnd.integers(-top, top, (d, n))
        exact = q.T @ c
        bound = np.quantile(exact, rnd.random(), axis=1).astype(np.int64)
        qi, ci, score = topk_search.search_block(q, c, bound)
        assert (score == exact[qi, ci]).all()
        want = set(zip(*np.nonzero(exact >= bound[:, None])))
        assert want <= set(zip(qi, ci)) and len(qi) == len(set(zip(qi, ci)))


def test_search_prunes():
    """In clustered vectors few pairs see all dimensions."""
    x = np.floor(64 * np.array(clustered(2000, 64, 8, spread=0.05))).astype(np.int64).T
    q = x[:, :100]
    exact = q.T @ x
    bound = np.sort(exact, axis=1)[:, -21]
    qi, _, _ = topk_search.search_block(q, x, bound)
    assert len(qi) < 0.1 * exact.size


# --- op 13 ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, c in docs[lang].items() if c >= least_docs]
        mine = [s for g, s in groups if g == lang]
        in_lang = Counter()
        for s in mine:
            in_lang.update(counts[lang, s])

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 2)) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)
        p, q = share(counts[lang, source]), share(in_lang)
        pairs = []
        for s in mine:
            if s != source:
                other = share(counts[lang, s])
                pairs.append((-sum(f(p[t], other[t]) for t in kept), s.encode()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(items, 1)]
    return sorted(out)


def audit_rows(seed=4, n=400):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéßЖ中") for _ in range(rnd.randint(1, 5))) for _ in range(120)]
    rows = []
    for _ in range(n):
        lang = rnd.choice(["en", "de", "fr", "one", None, ""])
        source = "only" if lang == "one" else rnd.choice(["hot"] * 5 + ["s1", "s2", "Ж", "é", None])
        text = " ".join(rnd.choice(vocab[: 40 if source == "hot" else 120]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice([text, text.upper(), text.replace(" ", "9_-\n")]), lang, source))
    rows += [(None, "en", "bare"), ("", "de", "bare"), ("123 !", "fr", "bare"), (None, None, None),
             ("rare words here", "xx", "a"), ("others there", "xx", "b"), ("KK İ ſ ǅ Ⅷ", "en", "s1")]
    return rows + rows[:40]


def audited(spark, rows, **opts):
    table = spark.createDataFrame([(r[0], r[1], r[2], "x", 1, b"y", 3) for r in rows],
                                  "text string, lang string, source string, term string, n int, split binary, "
                                  "value int").repartition(5)
    got = divergence.source_divergence(table, **opts)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def audit():
    rows = audit_rows()
    return rows, plain_divergence(rows, 10, 10)


def test_divergence(spark, audit):
    rows, want = audit
    assert audited(spark, rows) == want
    assert {r[2] for r in want} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in want


@pytest.mark.parametrize("bits", [2, 5])
def test_divergence_with_shared_digests(spark, audit, bits):
    rows, want = audit
    assert audited(spark, rows, bits=bits) == want


def test_divergence_in_tiles_and_blocks(spark, audit, monkeypatch):
    rows, want = audit
    monkeypatch.setattr(divergence, "ROWS_PER_CELL", 40)
    assert audited(spark, rows, tile=2) == want


def test_divergence_counts_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Some words, and a_very_LONG" + "é" * 40 + " one; then more " * 9
    want = [t.encode() for t in TERM.findall(text.translate(LOWER))]
    raw = text.encode().lower()
    pieces = list(divergence._terms(raw))
    assert [t for p in pieces for t in p] == want and len(pieces) > 3
    start, digest = divergence._digests(raw, 64)
    assert [raw[s:s + len(t)] for s, t in zip(start, want)] == want
    assert digest.tolist() == divergence._strings(want, 64)[0].to_pylist() and len(set(digest)) == len(set(want))
    assert [t for p in divergence._terms(("é" * 200).encode()) for t in p] == ["é".encode() * 200]


def test_counts_held_by_a_task_are_merged(spark, audit, monkeypatch):
    rows, want = audit
    monkeypatch.setattr(divergence, "SLICE", 300)
    monkeypatch.setattr(divergence, "HELD", 150)
    monkeypatch.setattr(divergence, "SPELLED", 50)
    assert audited(spark, rows) == want


def test_divergence_without_rows_or_terms(spark):
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [("a b", "en", "x"), ("a b", "en", "y")]) == [
        ("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).collect() == []


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (5, 9, 3), (10**12, 10**13, 10**8), (3 * 10**14, 4 * 10**14, 10**9), (7, 7 * 10**14, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    assert got == want
    for (n, t, v), w in zip(cases, want):
        assert divergence._shares(np.array([n]), np.array([t]), v)[0] == w
