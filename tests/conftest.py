import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.session import get_spark  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[4]", app="revlens-tests", shuffle_partitions=4)
    # Tests run without a cluster-provided checkpoint folder: set our own.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


def frame(spark, rows, batch="b"):
    return spark.createDataFrame([(i, batch, r) for i, r in enumerate(rows)],
                                 "review_id BIGINT, batch STRING, reviews STRING")
