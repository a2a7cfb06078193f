import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{min(8, os.cpu_count() or 1)}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def thue_morse():
    """Two unlike words of 2,048 letters, which polynomials modulo 2**64 hash alike whatever their base."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    return [a, a.translate(str.maketrans("ab", "ba"))]


@pytest.fixture
def docs(spark):
    """Documents with nulls, empties, repeats and an extra column whose name clashes with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id bigint, text string, n string, rep int")

    return make
