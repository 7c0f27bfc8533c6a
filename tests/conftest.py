import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clonara.session import local_session  # noqa: E402
from support import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="8", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from clonara.sources.views import Tables

    return Tables(spark, SF)


@pytest.fixture(scope="session")
def rows(spark):
    """The six-row repertoire plus planted edge cases, as one dataset of three repertoires."""
    data = [
        ("d_1", "r1", True, "CASSLAPGATNEKLFF", "TRBV20-1", "TRBJ2-7", 100.0, 1),
        ("d_1", "r1", True, "CASSLGQAYEQYF", "TRBV5-1", "TRBJ2-1", 50.0, 2),
        ("d_1", "r1", True, "CASSYNLTK", "TRBV20-1", "TRBJ2-7", 30.0, 3),
        ("d_1", "r1", True, "CASSLAPGATNEKLFF", "TRBV20-1", "TRBJ2-7", 100.0, 4),
        ("d_1", "r1", True, "CASSIRSSYEQYF", "TRBV6-2", "TRBJ1-3", 20.0, 5),
        ("d_1", "r1", True, "CASSQETQYF", "TRBV7-2", "TRBJ2-7", 10.0, 6),
        ("d_1", "r2", False, None, None, "", None, 1),
        ("d_1", "r2", False, "CA", "TRBV5-1*02", "TRBJ2-1*01", 3.0, 2),
        ("d_1", "r2", False, "CASSX*YF", "TRBV5-1", None, 2.0, 3),
        ("d_1", "r2", False, "CASSLGQAYEQYF", "TRBV5-1", "TRBJ2-1", None, 4),
        ("d_1", "r3", False, None, None, None, None, 1),
    ]
    return spark.createDataFrame(
        data, "dataset string, repertoire_id string, label_positive boolean, junction_aa string, v_call string, j_call string, templates double, row_order int")


@pytest.fixture(scope="session")
def metadata(spark):
    return spark.createDataFrame([("d_1", "r1", "r1.tsv", True), ("d_1", "r2", "r2.tsv", False), ("d_1", "r3", "r3.tsv", False)],
                                 "dataset string, repertoire_id string, filename string, label_positive boolean")
