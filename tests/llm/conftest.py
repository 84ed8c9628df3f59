"""Small tables with the cases that every operator must bear."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int = 40) -> str:
    """Words that depend on the seed; a full stop after every eighth."""
    out = []
    for k in range(n):
        w = WORDS[(seed * 7 + k * k * 3 + k * seed) % len(WORDS)] + str((seed * 31 + k * 17) % 97)
        out.append(w + "." if k % 8 == 7 else w)
    return " ".join(out)


BASE = sentence(1)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("alpha", "ALPHA")),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, sentence(2)),
    (7, sentence(2)),
    (8, "Été ΣΑΣ naïve 漢字 🙂   é ﬁn " + sentence(3, 9)),
    (9, sentence(4, 30) + "\n" + sentence(5, 24) + "\n" + sentence(6, 30)),
    (10, "12345 !!! 4111"),
    (11, " ".join(sentence(k, 60) for k in range(20, 60))),
    (None, sentence(8)),
    (None, None),
    (12, sentence(9, 16) + "\n" + sentence(5, 24)),
    (13, "one"),
]


def table(spark, rows=TEXTS):
    langs = ("en", "de", None)
    data = [(i, t, langs[(i or 0) % 3], f"src{(i or 0) % 2}", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture()
def docs(spark):
    return table(spark)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def clashing(docs):
    """The table with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("own") for c in ("fp", "h", "pos", "term", "score", "lang_pred", "n_lines", "ids", "decoded", "severity", "pii", "rank", "tie", "bucket", "node", "ord", "th")})
