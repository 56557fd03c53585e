"""Operators that look at one text at a time: token counts, packing, fingerprints,
secrets, toxicity."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphdelta.llm import fingerprints as fp
from graphdelta.llm import secrets, toxicity
from graphdelta.llm.packing import Packer, encoder, pack
from graphdelta.llm.token_counts import MergeCounter, counter, token_counts


def odd_texts(n=400, seed=1):
    rnd = random.Random(seed)
    alphabet = " \n\t▁ab<s>/é中😀\x00 the. ing"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


# token counts

def test_counts_equal_the_library_on_odd_texts():
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts() + ["", " ", "▁", "a" * 5000, "<s></s><unk>", "x " * 2000]
    assert [counter().text(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_merges_take_the_lowest_rank_and_the_leftmost_pair():
    c = MergeCounter({p: r for r, p in enumerate(["ab", "bc", "abc", "a", "b", "c"])})
    assert c.merged("abc") == 1  # ab, then abc
    assert MergeCounter({"bc": 0, "ab": 1, "a": 2, "b": 3, "c": 4}).merged("abc") == 2
    assert MergeCounter({"aa": 0, "a": 1}).merged("aaa") == 2
    assert c.merged("é") == 2  # two bytes, no piece


def test_token_counts_rows(docs, corpus):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, limit=50).collect())
    want = Counter((i, len((t or "").encode()), n := counter().text(t or ""), n > 50) for i, t in corpus)
    assert got == want


# packing

def check_pieces(pieces, size):
    sequences = defaultdict(list)
    for doc, start, ids, n, sequence, offset in pieces:
        sequences[sequence].append((offset, len(ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == size or at & (at - 1) == 0
    return len(sequences)


@pytest.mark.parametrize("sizes", [[600] * 500, [1], [1024], [1025, 1023, 5], list(range(1, 700))])
def test_packer_keeps_every_id_once(sizes):
    packer, pieces = Packer(1024, 20), []
    docs_ = [np.arange(n) + 7 * i for i, n in enumerate(sizes)]
    for i, ids in enumerate(docs_):
        pieces += packer.add(i, ids)
    pieces += packer.flush()
    check_pieces(pieces, 1024)
    for i, ids in enumerate(docs_):
        mine = sorted((s, p) for d, s, p, *_ in pieces if d == i)
        assert np.array_equal(np.concatenate([p for _, p in mine]), ids)
        assert [s for s, _ in mine] == list(np.cumsum([0] + [len(p) for _, p in mine])[:-1])


def test_best_level_minimises_the_sum_of_squares():
    rnd, packer = random.Random(2), Packer(16, 1000)
    for _ in range(300):
        packer.counts[1:16] = [rnd.randint(0, 3) for _ in range(15)]
        length = rnd.randint(1, 15)

        def cost(level):
            n = packer.counts[1:16].astype(int).tolist()
            if level:
                n[level - 1] -= 1
            if level + length < 16:
                n[level + length - 1] += 1
            return sum(x * x for x in n)
        levels = [0] + [h for h in range(1, 17 - length) if packer.counts[h]]
        assert cost(packer.best_level(length)) == min(map(cost, levels))


def test_pack_rows(docs, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(docs, size=64).collect()
    assert check_pieces([(r.doc_id, r.start, range(r.length), 0, r.sequence_id, r.offset) for r in got], 64)
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(np.array(full.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, all_ids in texts.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, all_ids))
        for r in pieces[i]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(
                ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in all_ids)


def test_encoder_treats_special_strings_as_the_library_does():
    e = encoder()
    for t in ["a<|endoftext|>b", "<|endoftext|>", *odd_texts(50)]:
        assert e(t) == e.full.encode(t, add_special_tokens=False).ids


# fingerprints

def test_signature_follows_order_and_repeats():
    text = "the quick brown fox jumps over the lazy dog " * 3
    a = fp.signature(text)
    assert np.array_equal(a, fp.signature(text)) and fp.likeness(a, a) == 1
    halves = text[len(text) // 2:] + text[:len(text) // 2]
    assert fp.likeness(a, fp.signature(halves)) < 1
    assert fp.likeness(a, fp.signature("something else entirely, with no part of it")) < 0.1
    assert fp.likeness(fp.signature(""), fp.signature("")) == 1
    assert fp.likeness(fp.signature(""), a) == 0
    assert fp.signature("ab").any() and fp.likeness(fp.signature("ab"), fp.signature("ba")) == 0


def test_signature_by_hand():
    """Selection and order against a plain rewriting."""
    rnd = random.Random(4)
    for _ in range(20):
        text = "".join(rnd.choice("ab cd") for _ in range(rnd.randint(6, 400)))
        seen, values, kmers = Counter(), [], []
        codes = np.array([ord(c) + 1 for c in text], dtype=np.uint64)
        for i in range(len(text) - fp.K + 1):
            x = np.full(1, fp.K, np.uint64)
            for j in range(fp.K):
                x = x * fp._B + codes[i + j]
            kmer = fp._mix(x)
            values.append(int(fp._mix(kmer + np.uint64(seen[text[i:i + fp.K]]) * fp._A)[0]))
            seen[text[i:i + fp.K]] += 1
            kmers.append(kmer)
        want = np.zeros(fp.BINS, dtype=np.uint32)
        for b in range(fp.BINS):
            mine = sorted((v, i) for i, v in enumerate(values) if v >> (64 - fp.BIN_BITS) == b)
            if mine:
                x = np.zeros(1, np.uint64)
                chosen = sorted(i for _, i in mine[:fp.KEEP])
                for j in range(fp.KEEP):
                    k = kmers[chosen[j]] if j < len(chosen) else np.zeros(1, np.uint64)
                    x = fp._mix(x * fp._A + k + np.uint64(j + 1))
                want[b] = max(int(x[0]) >> 32, 1)
        assert np.array_equal(fp.signature(text), want)


@pytest.mark.parametrize("count", [0, 1, 2, None])
def test_fingerprint_edits_rows(spark, corpus, no_docs, count):
    from tests.llm.conftest import SCHEMA, rows_of
    rows = corpus[:count]
    docs_ = spark.createDataFrame(rows_of(rows), SCHEMA) if rows else no_docs
    got = [tuple(r) for r in fp.fingerprint_edits(docs_).collect()]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))[::-1]
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        a, b, c = fp.signature(t), fp.signature(changed), fp.signature(following)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.text_of(a), fp.text_of(b),
                     fp.likeness(a, b), fp.likeness(a, c)))
    assert Counter(got) == Counter(want)


# secrets

PLAIN = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    lambda m: len(m.group(1)) >= 6),
         "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
         "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24)}


def plain_base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, good)) in enumerate(PLAIN.items())
             for m in re.finditer(p, text, re.ASCII) if good(m)]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


SECRETS = ["password = hunter2hunter2 and more", 'API_KEY: "abc"', "secret: token = abcdefgh", "tOkEn='x/y+z=123456'",
           "AKIA" + "A1B2" * 4, "AKIAAKIA" + "X" * 11, "AKIA" + "A" * 15, "é" * 9 + " deadbeef" * 4,
           "0123456789abcdef01234567", "0123456789ABCDEF01234567", "paſſword=abcdefgh", "toKen=abcdefgh",
           "passwd:" + "f" * 30, "", "key k9vXq2Lr8TzW4mNp7Bs1 here", "secret==a.b-c_d", 'secret"  :  "' + "z" * 6]


def test_base_spans_equal_the_plain_rules():
    rnd = random.Random(5)
    parts = ["password", "token", "=", ":", " ", '"', "AKIA", "A" * 18, "deadbeef", "0123", "é", "\n", "x", "secret"]
    texts = SECRETS + ["".join(rnd.choice(parts) for _ in range(14)) for _ in range(500)]
    for t in texts:
        got = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(t)]
        assert got == plain_base(t), t


def labelled_corpus(n=300):
    rnd = random.Random(6)

    def key(chars, k):
        return "".join(rnd.choice(chars) for _ in range(k))
    out = []
    for i in range(n):
        kind = i % 4
        out.append({0: f"they said password={key('0123456789abcdef', 18)} there",
                    1: f"write to {key('abcdefgh', 9)}.{rnd.randint(1, 99)}/mail{rnd.randint(0, 9)} or call",
                    2: f'and token = "{key("0123456789abcdef", 40)}" again',
                    3: f"number {rnd.randint(10**12, 10**13)}-{key('abcdefghijkl', 6)} of the list"}[kind])
    return out


def test_network_learns_and_keeps_the_recall():
    got = list({w for t in labelled_corpus() for w in secrets.labelled_windows(t)})
    y = np.array([label for label, _ in got], dtype=np.float32)
    x = np.stack([np.frombuffer(w, np.uint8).reshape(2, secrets.LENGTH) for _, w in got])
    order = np.random.default_rng(1).permutation(len(y))
    held, fitted = np.split(order, [len(y) // 3])
    net = secrets.CharCNN()
    net.fit(x[fitted], y[fitted], epochs=6)
    net.calibrate(x[held], y[held], recall=0.9)
    p = net.probability(x[held])
    assert ((p >= 0.5) == (y[held] > 0)).mean() > 0.95
    assert net.threshold >= secrets.LEAST_P
    if net.threshold > secrets.LEAST_P:
        assert (p[y[held] > 0] >= net.threshold).mean() >= 0.9


def test_recall_is_kept_below_one_half():
    """Rare findings among lookalikes score under 0.5: the threshold follows them."""
    rng = np.random.default_rng(2)
    x = np.zeros((900, 2, secrets.LENGTH), np.uint8)
    x[:, 0] = rng.integers(1, 30, x[:, 0].shape)
    x[:, 1, secrets.CONTEXT:secrets.CONTEXT + 30] = 1
    y = (np.arange(900) % 15 == 0).astype(np.float32)
    net = secrets.CharCNN()
    net.calibrate(x, y, recall=0.95)
    p = net.probability(x[y > 0])
    assert p.max() < 0.5
    assert (p >= net.threshold).mean() >= 0.95


def test_rare_findings_are_learnt_from_all_documents(spark, monkeypatch):
    """25 findings in 15,000 documents are enough, wherever they are."""
    rare = [t for t in labelled_corpus(100) if "password" in t]
    texts = rare + [f"number {10**12 + i}-{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3} of the list"
                    for i in range(15_000 - len(rare))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert secrets.fit_secret_model(frame.where("doc_id < 20")).network is None
    seen = []
    monkeypatch.setattr(secrets.CharCNN, "fit", lambda self, x, y: seen.append(int(y.sum())))
    monkeypatch.setattr(secrets.CharCNN, "calibrate", lambda self, x, y, recall: seen.append(int(y.sum())))
    secrets.fit_secret_model(frame)
    assert sum(seen) == len({w for t in rare for label, w in secrets.labelled_windows(t) if label})


def test_every_long_run_is_read_whole():
    """Without a digit, parted by marks, and in the middle of a long candidate."""
    key = "kqXvTzWmNpRsBdLc"
    parted = "aB3.kQ9~xV7.zW2"
    text = f'use {key} or "{parted}", see end.'
    assert [text[s:e] for s, e in secrets.candidates(text)] == [key, parted]
    glued = f"{key}{parted[3:]}"
    assert [glued[s:e] for s, e in secrets.candidates(glued)][0] == key
    for n in (12, 56, 57, 84, 85, 300):
        at = secrets.pieces(5, 5 + n)
        assert {i for s, e in at for i in range(s, e)} == set(range(5, 5 + n))
        assert all(e - s <= secrets.INSIDE for s, e in at)

    class Marked:
        threshold = 0.5

        def probability(self, x):  # one odd symbol, deep inside
            return ((x[:, 0] == secrets._TABLE[ord("+")]) & (x[:, 1] == 1)).any(axis=1).astype(float)
    long = "x" * 150 + "+" + "y" * 150
    assert secrets.find_spans([long, "z" * 300], secrets.SecretModel(Marked())) == [[(0, 3, 301)], []]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x = np.zeros((6, 2, secrets.LENGTH), np.uint8)
    x[:, 0] = rng.integers(0, secrets.SYMBOLS, x[:, 0].shape)
    x[:, 1, 20:50] = 1
    y = np.array([0, 1, 0, 1, 1, 0], np.float32)
    net = secrets.CharCNN()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net._forward(x)[3]
        return np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y))
    for k, g in net._gradients(x, y).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        v = net.p[k][i]
        net.p[k][i] = v + 1e-5
        up = loss()
        net.p[k][i] = v - 1e-5
        assert abs((up - loss()) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i]))
        net.p[k][i] = v


def test_secret_rows(spark, docs, corpus, no_docs):
    from tests.llm.conftest import SCHEMA, rows_of
    texts = SECRETS + labelled_corpus() + [None]
    frame = spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA).union(docs)
    model = secrets.fit_secret_model(frame)
    assert model.network is not None
    found = secrets.scan_secrets(frame, model)
    assert found.count() == len(texts) + len(corpus)
    rows = {r.doc_id: r for r in secrets.digest(found.where("doc_id >= 0").limit(10**9)).collect()
            if r.doc_id is not None}
    for i, t in list(enumerate(texts))[len(corpus) + 10:]:  # ids that only the one table has
        base = plain_base(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert [s for s in spans if not s.startswith("model:")] == base
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(
            sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
    assert secrets.scan_secrets(no_docs, secrets.fit_secret_model(no_docs)).count() == 0


# toxicity

def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 600)
    rows = [np.unique(np.r_[rng.integers(100, 2000, 30), np.arange(g * 5)]).astype(np.int32) for g in grades]
    model = toxicity.fit_ordinal(rows[:400], grades[:400], steps=150, l2=1e-4)
    assert (np.diff(model.thresholds) > 0).all()
    severity = np.array([model.above(r).sum() for r in rows[400:]])
    means = [severity[grades[400:] == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    for r in rows[400:420]:
        assert (np.diff(model.above(r)) <= 0).all()


def test_toxicity_on_held_out_labels(spark, docs):
    sf = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = labels.where("pmod(doc_id, 3) <> 0")
    model = toxicity.fit_toxicity(texts, some, max_rows=3000)
    held = labels.where("pmod(doc_id, 3) = 0")
    got = toxicity.score_toxicity(texts, model).join(held.withColumnRenamed("toxic", "truth"), "doc_id")
    n = Counter((r.toxic, r.truth) for r in got.select("toxic", "truth").collect())
    assert n[True, 1] / (n[True, 1] + n[True, 0]) > 0.9
    assert n[True, 1] / (n[True, 1] + n[False, 1]) > 0.8


def test_toxicity_rows(spark, docs, corpus, no_docs):
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(range(1, 60))], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in corpus)
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 and 0 <= r.grade <= 3 for r in got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    assert kept.count() == sum(not r.toxic for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect())
    assert toxicity.score_toxicity(no_docs, toxicity.fit_toxicity(no_docs, labels)).count() == 0
