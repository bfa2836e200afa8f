from pyspark.sql import functions as F

from cellweave.sources import cells
from cellweave.streaming.shares import parquet_stream, windowed_shares


def test_read_cells_adds_metadata_and_cleans_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",cell:CD4,x:size\n0,1.5,10\n1,2.5,20\n")
    (tmp_path / "b.csv").write_text(",cell:CD4,cell:CD8\n0,3.5,7.0\n")
    df = cells.read_cells(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "cellseg", ["r1", "r2"], ["c", "d"])
    rows = sorted((r["CD4"], r["area"], r["CD8"], r["region_num"], r["unique_region"], r["condition"]) for r in df.collect())
    assert rows == [(1.5, 10, None, "0", "r1", "c"), (2.5, 20, None, "0", "r1", "c"), (3.5, None, 7.0, "1", "r2", "d")]


def test_text_files_and_region_sink(spark, tmp_path, small):
    (tmp_path / "names.txt").write_text('"DAPI",\nCD4\n\n')
    assert [r["name"] for r in cells.read_names(spark, str(tmp_path / "names.txt")).collect()] == ["DAPI", "CD4"]
    assert cells.list_files(spark, str(tmp_path), ".txt").count() == 1
    view = cells.cells_view(spark, small)
    cells.write_by_region(view, str(tmp_path / "out"), "region", ["cell_id", "x", "y"])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == view.count() and set(back.columns) == {"cell_id", "x", "y", "region"}
    named = spark.createDataFrame([("a/b/r1_plot.png_cut.png",)], "p string")
    assert named.select(cells.bare_name("p")).first()[0] == "r1"


def test_streamed_shares_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "event_type")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    out = windowed_shares(parquet_stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", "1 day", "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("shares").start()
    try:
        q.processAllAvailable()
        got = sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("shares").collect())
    finally:
        q.stop()
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert got == sorted((r["start"], r["event_type"], r["count"]) for r in want.collect())
