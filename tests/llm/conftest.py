import os
import random

import pytest

# workers import the package from the repository, wherever the tests are started
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

# Extra columns whose names the operators use inside.
SCHEMA = ("doc_id long, text string, doc string, th string, key string, part string, n string, "
          "found string, root string, line string, w string, c0 string, label string")
EXTRA = ("x",) * 11


def rows_of(texts):
    """[(doc_id, text)] with the clashing columns filled."""
    return [(i, t, *EXTRA) for i, t in texts]


def make_corpus(seed: int = 3, n: int = 60):
    """Texts with copies, near copies, shared passages and lines, a passage that
    many share, empty and odd ones; [(doc_id, text)], ids not in order."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abdeiklmnorstuéñ") for _ in range(rnd.randint(2, 8))) for _ in range(900)]

    def words(k):
        return [rnd.choice(vocab) for _ in range(k)]

    def lines(ws):
        out, i = [], 0
        while i < len(ws):
            k = rnd.randint(3, 25)
            out.append(" ".join(ws[i:i + k]))
            i += k
        return "\n".join(out)

    passage, common = words(60), words(40)
    texts = []
    for _ in range(n):
        ws = words(rnd.choice([1, 3, 4, 5, 6, 20, 80, 150, 300]))
        if rnd.random() < 0.3:
            at = rnd.randint(0, len(ws))
            ws[at:at] = passage
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(ws))
            ws[at:at] = common[: rnd.choice([34, 35, 36, 40])]
        texts.append(lines(ws))
    base = texts[5] if len(texts[5]) > 400 else lines(words(200))
    for k in range(25):  # a group of near copies, each with its own edits
        ws = base.split(" ")
        for _ in range(k % 4):
            ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
        texts.append(" ".join(ws))
    texts += [texts[7]] * 6 + [texts[9].upper()] + [None, "", "   ", "\n\n", "a", "a", "A b c d", "a b c d"]
    texts.append(" ".join(words(3000)))
    texts.append((texts[7] + "\n") * 3)
    ids = list(range(1, len(texts) + 1))
    rnd.shuffle(ids)
    out = list(zip(ids, texts))
    out += [out[3], out[3], (out[8][0], "another text under an id that is taken"), (None, texts[11]), (None, "lost")]
    return out


@pytest.fixture(scope="session")
def corpus():
    return make_corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.environ["PYTHONPATH"])
    return spark.createDataFrame(rows_of(corpus), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], SCHEMA)
