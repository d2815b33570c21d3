from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featureflow.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, shuffle_partitions=4, app_name="featureflow-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path_factory) -> str:
    """A fresh folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="ff-test-", dir=str(tmp_path_factory.getbasetemp()))


def rows(df, *order):
    """Collect as sorted list of dicts (test helper on small frames)."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    key = order or tuple(df.columns)
    return sorted(out, key=lambda d: tuple((d[k] is None, d[k]) for k in key))
