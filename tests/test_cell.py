import math

import pytest
from pyspark.sql import functions as F

from mdframes.functions import cell as C


def frame(spark, *cell):
    return spark.createDataFrame([("t", 0, *map(float, cell))], "traj string, frame bigint, a double, b double, c double, "
                                 "alpha double, beta double, gamma double")


def test_triclinic_volume(spark):
    v = frame(spark, 10, 10, 10, 90, 90, 60).select(F.expr(C.cell_volume()).alias("v")).first()["v"]
    assert v == pytest.approx(866.0254037844386)


def test_impossible_angles_give_null(spark):
    assert frame(spark, 10, 10, 10, 10, 10, 170).select(F.expr(C.cell_volume()).alias("v")).first()["v"] is None


def test_flat_cell_is_an_error(spark):
    with pytest.raises(Exception, match="no cell"):
        C.with_cell_matrix(frame(spark, 10, 10, 10, 90, 90, 180)).collect()


def test_minimum_image_rounds_half_to_even(spark):
    f = C.with_cell_matrix(frame(spark, 20, 20, 20, 90, 90, 90))
    for d, want in ((10.0, 10.0), (30.0, -10.0), (50.0, 10.0), (-10.0, -10.0)):
        row = C.minimum_image(f.withColumn("d", F.lit(d)), "d", "0D", "0D", ("ox", "oy", "oz")).first()
        assert row["ox"] == want


def test_volume_of_invalid_lengths(spark):
    assert frame(spark, 0, 10, 10, 90, 90, 90).select(F.expr(C.orthorhombic_volume()).alias("v")).first()["v"] is None


def test_matrix_is_a_cell(spark):
    r = C.with_cell_matrix(frame(spark, 12, 11, 10, 80, 95, 105)).first()
    c = (r["cx"], r["cy"], r["cz"])
    assert math.sqrt(sum(v * v for v in c)) == pytest.approx(10.0)
    assert r["ax"] * r["by"] * r["cz"] == pytest.approx(r["volume"])
