import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lithoflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    s = local_session(4, "tests", spark__sql__warehouse__dir=str(where / "warehouse"), spark__driver__memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
