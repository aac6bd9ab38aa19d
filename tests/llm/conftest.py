import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a very long text, clashing extra columns."""
    long = " ".join(f"word{i % 977} stone{i % 61}" for i in range(40_000))
    rows = [
        (1, "one two three four five six seven", "en", 1), (1, "one two three four five six seven", "en", 1), (1, "another text of the same id", "en", 2), (2, None, None, 3), (3, "", "en", 4),
        (4, " \n\t ", "de", 5), (5, long, "en", 6), (6, long, "en", 7), (7, "ein zwei drei", "de", None), (None, "no id at all here", "en", 8), (None, None, None, None), (8, "12345 !!!", "en", 9),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, cls int")


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.where("false")
