import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tastegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def ratings(spark):
    """Forty users over thirty items with skew: user 0 has rated every item, item 0 is rated by everybody."""
    import random

    rnd = random.Random(5)
    rows = set()
    for u in range(40):
        items = range(30) if u == 0 else {0, *(rnd.randrange(30) for _ in range(rnd.randrange(2, 9)))}
        rows |= {(u, i) for i in items}
    data = [(u, i, float(rnd.randrange(1, 6)), rnd.randrange(20)) for u, i in sorted(rows)]
    return spark.createDataFrame(data, "user long, item long, rating double, ts long").cache()
