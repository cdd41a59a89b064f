import numpy as np
import pytest


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, None), (None, 1, 1), (8, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture
def rng():
    return np.random.default_rng(3)
