"""The single-series models see every event."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.plans import model_queries
from barloom.plans.registry import hourly_all
from barloom.sources.tables import read_table


def test_single_series_holds_all_events(spark, sf):
    hours = read_table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts")).distinct()
    bars = hourly_all(spark, sf)
    assert bars.count() == hours.count() and {r.symbol for r in bars.select("symbol").distinct().collect()} == {"ALL"}
    rows = model_queries.model_rows(spark, sf)
    assert {r.symbol for r in rows.select("symbol").distinct().collect()} == {"ALL"}
    spans = model_queries._splits(spark, sf)
    assert spans.select("row_id").distinct().count() == bars.count()
    blocks = entry.queries()["clustered_blocks"](spark, sf)
    assert blocks.where("role = 'test'").select("row_id").distinct().count() == bars.count()
