import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import drop_checkpoints, local_session

    session = local_session("4", 4, "4g")
    yield session
    drop_checkpoints()
    session.stop()


@pytest.fixture
def frame(spark):
    """A point table from tuples, with ids from 0."""

    def make(points, axes="xyz", **columns):
        names = list(axes[: len(points[0])]) if points else list(axes[:2])
        rows = [(i, *map(float, p), *(v[i] for v in columns.values())) for i, p in enumerate(points)]
        schema = "id bigint, " + ", ".join(f"{n} double" for n in names) + "".join(f", {c} {'double' if not v or isinstance(v[0], float) else 'bigint' if isinstance(v[0], int) else 'string'}" for c, v in columns.items())
        return spark.createDataFrame(rows, schema)

    return make
