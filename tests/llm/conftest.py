import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    return odd.documents(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return odd.nothing(spark)
