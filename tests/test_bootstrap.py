"""The bootstrap numbers its rows in order of value, as its SQL does."""
from rastrum.operators import analysis as an


def test_rows_of_the_same_key_count_apart(spark):
    rows = spark.createDataFrame([("e", 1, 7, float(v)) for v in range(50)], "experiment_id string, experiment_version int, image_id int, v double")
    got = an.bootstrap_ci(rows, "v").first()
    assert got["n"] == 50 and got["ci_low"] < got["ci_high"]
    other = an.bootstrap_ci(rows.withColumn("image_id", rows["v"].cast("int")), "v").first()
    assert (got["ci_low"], got["ci_high"]) == (other["ci_low"], other["ci_high"])
