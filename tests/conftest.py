import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from footgrid.session import build_session
    s = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def pixel_rows(spark, grid, image=0, value="v"):
    """Dense pixel table of a 2-D list or array."""
    rows = [(image, r, c, int(v) if float(v).is_integer() else float(v))
            for r, line in enumerate(grid) for c, v in enumerate(line)]
    kind = "int" if all(isinstance(x[3], int) for x in rows) else "double"
    rows = [(a, b, c, v if kind == "int" else float(v)) for a, b, c, v in rows]
    return spark.createDataFrame(rows, f"image long, r int, c int, {value} {kind}")


def to_grid(df, shape, value="v"):
    import numpy as np
    out = np.zeros(shape)
    for row in df.collect():
        out[row.r, row.c] = row[value]
    return out
