import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkselect.session import get_session
    s = get_session(cpus="4", shuffle_partitions=8, app="sparkselect-tests")
    yield s


@pytest.fixture(scope="session")
def t1(spark):
    from pyspark.sql import functions as F

    from sparkselect.plans.common import assemble
    from sparkselect.plans.tasks import t1_events
    df = assemble(t1_events(spark, SF), ["value", "k", "h"]).withColumn("label", F.col("y").cast("double"))
    return df.cache()
