from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import duck, session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session("4", "4")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture
def raw(spark):
    """A table of raw lines, numbered from 0."""

    def make(lines):
        return spark.createDataFrame(list(enumerate(lines)), "line_key bigint, raw string")

    return make
