import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strata.session import get_spark
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield s


@pytest.fixture(autouse=True)
def keep_settings(request):
    """Settings a test changes through `shuffle_partitions` end with it."""
    yield
    if "spark" in request.fixturenames:
        from tests.helpers import restore
        restore(request.getfixturevalue("spark"))
