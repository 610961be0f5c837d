import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from domloom.session import build_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("domloom-tests", 4, **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    yield session
    session.stop()


@pytest.fixture
def pages_of(spark):
    """Pages from HTML strings, numbered from 1."""

    def build(*htmls):
        rows = [(i, f"http://h/{i}", h) for i, h in enumerate(htmls, 1)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return build
