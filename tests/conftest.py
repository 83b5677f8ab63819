from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from loanweave.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("loanweave-tests", "8", 4))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def table(spark):
    """Builds a small table from dicts; absent columns are null."""

    def build(rows: list[dict], schema: str):
        names = [part.split()[0] for part in schema.split(",")]
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)

    return build
