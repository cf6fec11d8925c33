import random

import pytest
from pyspark.sql import types as T

from marketlens.llm.common import tuned

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       T.StructField("id", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("h", T.IntegerType()), T.StructField("line", T.StringType()),
                       T.StructField("length", T.StringType())])


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Épée", "straße", "node", "edge,", "tree.", "x1"]) +
                    str(rng.randrange(400)) for _ in range(n))


def corpus():
    """Texts with every awkward case: null, empty, blank, tiny, long, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(30)]
    texts = [None, "", "   \n\t", "a", "a", "é", "\n\n", "x" * 450, "ab " * 300, words(rng, 9000)]
    texts += base
    texts += [b + "\n" + passage + "\n" + words(rng, 8) for b in base[:6]]
    texts += [base[7], base[7], base[7] + " ", base[7].replace("alpha", "alphas", 1), base[8].upper()]
    texts += [base[9] + "\n" + base[10] + "\n\n" + base[11], base[10], base[11][:-1] + "?"]
    texts += ["🙂 emoji " + base[12], base[12] + " <|endoftext|> tail"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(None, base[3]), (None, None), (4, base[4]), (4, base[4]), (7, "other text of a repeated id")]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", None]), None if t is None else len(t),
             "clash", "clash", 1, "clash", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return tuned(spark).createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return tuned(spark).createDataFrame([], SCHEMA)
