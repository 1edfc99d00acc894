import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from rowsmith.session import LOCAL_CONF, checkpoint_dir, ship_package

    b = SparkSession.builder.master("local[4]").appName("rowsmith-tests")
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    ship_package(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF = "/root/testdata/sf0.001"
