from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("TRAWL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trawl.session import local_session

    session = local_session(
        8, spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def toy_docs(spark):
    from helpers import TOY

    return spark.createDataFrame(TOY, "id string, contents string").cache()


@pytest.fixture(scope="session")
def fts_index(toy_docs):
    from trawl.plans.search import index_contents

    return index_contents(toy_docs, "fts5")
