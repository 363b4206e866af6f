import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patronage.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    yield get_spark("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})


@pytest.fixture
def raw_pdf():
    """A hundred invoice lines by rule: 20 customers with five invoices each, a
    line an invoice, three categories, prices and discounts that cycle."""
    rows = []
    for line in range(100):
        buyer, turn = line % 20, line // 20
        rows.append({
            "InvoiceID": f"INV{line:06d}", "CustomerID": f"C{buyer + 10}",
            "InvoiceDate": pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=(7 * line) % 97),
            "ProductCategory": "ABC"[(buyer + turn) % 3], "ProductID": f"P{100 + (13 * line) % 90}",
            "Quantity": 1 + (line * line) % 5, "UnitPrice": (150.0, 420.0, 980.0)[line % 3],
            "DiscountPct": (0.0, 15.0)[turn % 2], "PaymentMethod": ("Card", "Transfer")[line % 2],
            "Returned": line % 6 == 0})
    return pd.DataFrame(rows).astype({"Quantity": "int32"})


@pytest.fixture
def raw_df(spark, raw_pdf):
    from patronage.sources.tables import TRANSACTION_SCHEMA
    return spark.createDataFrame(raw_pdf, TRANSACTION_SCHEMA)


def blobs(n=100, seed=42, centers=3, d=2, std=0.6):
    rng = np.random.RandomState(seed)
    c = rng.uniform(-8, 8, size=(centers, d))
    lab = rng.randint(0, centers, n)
    X = c[lab] + rng.normal(scale=std, size=(n, d))
    return X, lab


@pytest.fixture
def blob_df(spark):
    X, lab = blobs()
    pdf = pd.DataFrame({"id": np.arange(len(X)), "x0": X[:, 0], "x1": X[:, 1], "label": lab})
    return spark.createDataFrame(pdf)
