import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Texts that trouble: nothing, white space, marks, other scripts, copies, one very long.
TEXTS = [
    None,
    "",
    " ",
    "a",
    "a b",
    "Ab aB",
    "\n\n\t",
    "x" * 5000,
    "ça va　bien  là\n\nnon",
    "日本語 テキスト <|endoftext|> \\### </turn>",
    "a b c d e f",
    "A B C D E F",
    "zero\x00one two\rthree\r\nfour",
    "the end. the end. the end. the end. the end. the end.\nthe end.\nthe end.",
]


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    base = words(rng, 300, 500).split()
    near = list(base)
    near[10] = "other"
    texts = [*TEXTS, " ".join(base), " ".join(near), " ".join(base), words(rng, 20000, 3000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows.append((0, None))  # a repeated row
    rows.append((None, "no id here at all"))
    return rows


CLASHING = ["size", "shard", "slot", "digest", "license", "kept", "n_words", "label", "node", "component", "part", "borrowed", "keys", "rate", "_rate", "h", "d", "b", "_h", "base", "worker", "bin"]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The troubling rows, with columns that bear the operators' own names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(i, t, *["?"] * len(CLASHING)) for i, t in odd_rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
