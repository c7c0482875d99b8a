import datetime

from quire.streaming import pages

from .test_checks import page


def test_pages_stay_as_first_brought_and_documents_grow(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    at = datetime.datetime(2024, 1, 1)
    write = lambda *rows: spark.createDataFrame([(*r, at) for r in rows], pages.CHUNK).coalesce(1).write.mode("append").parquet(folder)
    write((1, 0, page(1, "a") + page(2, "b")))
    write((1, 1, page(2, "late") + page(3, "c")))
    stream = pages.first_pages(pages.arriving(spark, folder))
    q = stream.writeStream.format("memory").queryName("first_pages").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.page_no for r in spark.table("first_pages").collect()) == [1, 2, 3]
    q = pages.arriving(spark, folder).writeStream.foreachBatch(pages.merged_batches(root)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{root}/documents").first().md == "\n\n".join((page(1, "a"), page(2, "b"), page(3, "c")))
