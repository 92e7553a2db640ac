import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketsense.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "4g")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture()
def small_groups(monkeypatch):
    """Spans of 8 days, so that short series cross many groups."""
    from marketsense.operators import series

    monkeypatch.setattr(series, "SPAN_DAYS", 8)


def bars_frame(spark, closes, ticker="T", volume=None, start="2024-01-01"):
    import pandas as pd

    dates = pd.date_range(start, periods=len(closes)).date
    rows = [
        (ticker, d, c, None if c is None else c + 1.0, None if c is None else c - 1.0, float(v))
        for d, c, v in zip(dates, closes, volume or [10.0] * len(closes))
    ]
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")


def by_date(df, *names):
    return [tuple(row[n] for n in names) if len(names) > 1 else row[names[0]] for row in df.orderBy("ticker", "date").collect()]
