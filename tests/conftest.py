import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Inputs are a few rows: interpreting the plans is much faster than compiling them.
    s = local_session(
        4,
        "tests",
        spark__sql__shuffle__partitions="2",
        spark__sql__codegen__wholeStage="false",
        spark__sql__codegen__factoryMode="NO_CODEGEN",
    )
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def lines(spark):
    """Lines as a frame, numbered from 1."""

    def make(rows, file_id=0):
        return spark.createDataFrame(
            [(file_id, i + 1, r) for i, r in enumerate(rows)], "file_id int, line_no long, line string"
        )

    return make


@pytest.fixture
def write(tmp_path):
    """Write tab-separated rows to a file."""

    def make(name, rows):
        path = tmp_path / name
        path.write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
        return str(path)

    return make
