import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from nearmark.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="nearmark-tests")
    yield s
    s.stop()


GOLDEN_TRAIN = [(0, 0, 0.2), (0, 2, 0.5), (1, 0, 0.8), (1, 1, 0.4), (2, 2, 0.3), (3, 1, 0.6), (3, 3, 0.2),
                (4, 2, 0.1), (5, 0, 0.1), (5, 3, 0.7), (6, 2, 0.5)]
GOLDEN_TEST = [(0, 3), (1, 3), (2, 1), (3, 0), (4, 1), (5, 2), (6, 2)]


@pytest.fixture(scope="session")
def golden_pairs(spark):
    return spark.createDataFrame([(u, i) for u, i, _ in GOLDEN_TRAIN], "u bigint, i bigint")


@pytest.fixture(scope="session")
def golden_edges(spark):
    return spark.createDataFrame(GOLDEN_TRAIN, "u bigint, i bigint, d double")
