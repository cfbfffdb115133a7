from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)


@pytest.fixture(scope="session")
def folder() -> str:
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


def values(df, *columns):
    """Rows as plain tuples, in a stable order."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=str)
