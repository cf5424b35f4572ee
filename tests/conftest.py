import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakeops.session import get_session
    s = get_session("local[4]", app="lakeops-tests", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lakeops-test-wh-"),
    })
    # Tests stand in for the cluster: the checkpoint folder is only set here because it is unset.
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="lakeops-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
        s.conf.set("spark.checkpoint.dir", d)
    yield s


@pytest.fixture()
def tmpdir_new():
    return tempfile.mkdtemp(prefix="lakeops-test-")


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
