import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from likeness.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests")
    yield session
    session.stop()


def people_rows(n=120, people=4, groups=6, dim=8, noise=0.4, seed=3):
    """Separable individuals: one direction each plus noise. Group g of individual p is unique to p."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, dim))
    rows = []
    for i in range(n):
        p, g = i % people, (i // people) % groups
        rows.append(("m", i, 0, f"p{p}", f"g{p}-{g}", f"s{i % 3}", f"f{p % 2}", "single",
                     [float(x) for x in centres[p] + noise * rng.normal(size=dim)]))
    return rows


SCHEMA = "model string, item long, window int, ind string, grp string, stratum string, family string, kind string, v array<double>"


@pytest.fixture(scope="session")
def people(spark):
    return spark.createDataFrame(people_rows(), SCHEMA).persist()
