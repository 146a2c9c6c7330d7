"""The shared session, the smallest tables, and a helper for tables with odd rows."""

from __future__ import annotations

import pytest

from txnsift.llm import queries


@pytest.fixture(scope="session")
def smallest() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def run(spark):
    """Rows of a registered query as pandas."""
    return lambda name, sf_dir: queries.QUERIES[name](spark, sf_dir).toPandas()


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes frames as the tables of a folder and returns its path."""

    def write(**tables) -> str:
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
