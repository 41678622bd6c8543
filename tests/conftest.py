import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runledger.operators import ordered  # noqa: E402
from runledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("checkpoints")
    session = local_session(4, partitions=4, **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture
def small_groups(monkeypatch, spark):
    """Make blocks of so many rows and, for few, chunks that Spark doesn't unite, so that small
    groups span several."""
    united = "spark.sql.adaptive.coalescePartitions.enabled"

    def limit(rows: int) -> None:
        monkeypatch.setattr(ordered, "BLOCK_ROWS", rows)
        spark.conf.set(united, str(rows >= 1000).lower())

    yield limit
    spark.conf.set(united, "true")
