from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from trialstats.session import local_session, removing_stored  # noqa: E402

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def stored_tables_go(spark):
    """The tables stored by the tests of a module are removed after it."""
    with removing_stored(spark):
        yield


@pytest.fixture(scope="session")
def tiny():
    """The smallest test tables."""
    return _folder("sf0.001")


@pytest.fixture(scope="session")
def small():
    return _folder("sf0.01")


def _folder(name: str) -> str:
    path = f"{TESTDATA}/{name}"
    if not os.path.isdir(path):
        pytest.skip(f"{path} is absent")
    return path


@pytest.fixture(scope="session")
def make_trials(spark):
    """Trials from (task_id, sample_index, initial_state, final_state[, base_state]) tuples."""

    def make(rows, control=False):
        schema = "task_id string, sample_index int, initial_state string, final_state string"
        return spark.createDataFrame(rows, schema + (", base_state string" if control else ""))

    return make


def rows(df):
    """Rows as plain tuples, sorted by their texts."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))
