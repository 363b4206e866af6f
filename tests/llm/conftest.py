import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from patronage.session import get_spark  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return get_spark("local[4]", shuffle_partitions=4,
                     extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeated rows, odd characters, a long text, and columns
    whose names clash with those of the operators."""
    rows = [
        (1, "The card 4111 1111 1111 1111 and a@b.co here", "en", "s1", 5),
        (1, "The card 4111 1111 1111 1111 and a@b.co here", "en", "s1", 5),
        (2, None, "en", None, None), (3, "", None, "s2", 0), (None, "no id 10.0.0.1", "en", "s1", 1),
        (4, " \t\n ", "en", "s2", 3), (5, "\U0001f600 中文 don't 'll I'd\r\n\n x", "zz", "s2", 9),
        (6, "word " * 30000 + "end +1 (743) 555-3824.", "en", "s3", 1),
        (7, "same line of text here\n" * 40, "en", "s3", 1), (8, "12345 !!! ###", "en", "s3", 1),
        (9, "The card 4111 1111 1111 1111 and a@b.co here", "en", "s1", 5),
    ]
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows],
                                 DOCS + ", n_tokens int, ids string, fp long, skey string, a int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
