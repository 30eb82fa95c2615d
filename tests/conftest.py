import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lintlake.session import get_spark

    s = get_spark(cores="*", app="lintlake-tests", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def code_sf(tmp_path_factory):
    """The smallest tables with a table of source files beside them."""
    import pyarrow.parquet as pq
    from code_templates import write_code_files

    folder = tmp_path_factory.mktemp("code")
    for name in os.listdir(SF_SMALL):
        os.symlink(f"{SF_SMALL}/{name}", folder / name)
    write_code_files(pq.read_table(f"{SF_SMALL}/documents.parquet")["doc_id"].to_pylist(), str(folder))
    return str(folder)


@pytest.fixture(scope="session")
def duck(code_sf):
    from lintlake.plans.check import duck as mk

    return mk(code_sf)
