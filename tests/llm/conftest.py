import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

@pytest.fixture()
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that operators use."""
    long = "long word " * 30_000
    rows = [(1, "a b c d e f", 7, "x"), (1, "a b c d e f", 7, "x"), (None, "null id here", 0, "y"), (2, None, 1, None), (3, "", 1, "z"), (4, long, 2, "w"), (1, "another text of id one", 3, "v"), (None, None, None, None), (5, " \n\t ", 1, "u")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, block string").selectExpr("*", "1 as fp", "2 as shard", "3 as ids", "4 as words", "5 as text_hash", "6 as bucket")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
