import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fluxsite.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="fluxsite-tests")
    yield s
    s.stop()


def same(a, b, rel=1e-6):
    """Equality for report cells: NULL, NaN and +-Inf compare as values."""
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        if math.isinf(a) or math.isinf(b):
            return a == b
        return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
    return a == b


def assert_row(row, expected: dict):
    for k, v in expected.items():
        assert same(row[k], v), f"{k}: got {row[k]!r}, expected {v!r} in {row}"
