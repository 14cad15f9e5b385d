import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

#: Rows that every operator on documents has to take: NULLs, empty and blank texts, repeats, ties, a long text.
ODD = [
    (None, "the quick brown fox jumps over the lazy dog again and again"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"),
    (5, "One two three four"), (6, "one TWO three four"), (None, None), (7, "Äß ñ 日本 \u2028 x\x1cy İ <|endoftext|> it's 3.14"), (8, "word " * 30_000),
    (9, " ".join(f"w{i}" for i in range(300))), (10, " ".join(f"w{i}" for i in range(3, 300))), (-1, "a b c d e f g h i j k l m n o p"),
]
DOCUMENTS = "doc_id long, text string, score double, n_words long, found string, key string, row int, component long, weights string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns named as the operators' own."""
    return spark.createDataFrame([(i, t, 0.5, 7, "x", None, 3, 4, "w") for i, t in ODD], DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
