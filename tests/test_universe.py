import pytest
from tests.helpers import SIX, panel

from barloom.operators import quality


def test_symbol_listed_twice_is_refused(spark):
    members = [("A", None, None, "included"), ("A", None, None, "included")]
    universe = spark.createDataFrame(members, "symbol string, valid_from date, valid_to date, inclusion_status string")
    bars = panel(spark, SIX)
    assert quality.eligible_rows(bars, universe.limit(1)).count() == 6
    with pytest.raises(Exception, match="duplicate key A"):
        quality.eligible_rows(bars, universe).collect()


def test_late_bar_stops_the_stream(spark, tmp_path):
    from barloom.streaming import jobs

    bars = panel(spark, SIX).select("symbol", "date", "close")
    folder = str(tmp_path / "bars")
    bars.where("date >= '2024-01-04'").coalesce(1).write.parquet(folder)
    stream = jobs.running_indicators(jobs.source(spark, folder, "*.parquet", bars.schema))

    def run():
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    bars.where("date < '2024-01-04'").coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="after that of"):
        run()
