"""SQL functions give what the Column functions give."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestrank import fixtures as FX
from nestrank.functions import sql_functions
from nestrank.operators import signals as SG


def test_sql_functions_equal_columns(spark):
    names = sql_functions.register(spark, "nr_")
    assert {"nr_haversine_m", "nr_text_quality", "nr_tranquility"} <= set(names)
    raw = FX.raw_listings(spark, "/root/testdata/sf0.001").select("id", "lat", "lon", "description").unionByName(
        spark.createDataFrame([(-1, None, -74.0, None), (-2, 40.7, -74.0, "")], "id long, lat double, lon double, description string")
    )
    want = SG.tranquility(SG.text_quality(raw, "description", name="q")).select("id", "tranquility_score", "q")
    got = spark.sql("SELECT id, nr_tranquility(lat, lon) AS t, nr_text_quality(description) AS g FROM {raw}", raw=raw)
    both = got.join(want, "id").where(~F.col("t").eqNullSafe(F.col("tranquility_score")) | (F.abs(F.col("g") - F.col("q")) > 1e-9))
    assert both.count() == 0 and got.count() == want.count()
    assert round(spark.sql("SELECT nr_haversine_m(0, 0, 0, 1) AS d").first().d) == 111195
