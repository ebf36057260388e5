from pyspark.sql import functions as F

from tarnwick.sources import generations as G
from tarnwick.streaming.ingest import ingest, settled


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "document_id string, n int")
    new = spark.createDataFrame([("d1", 9)], "document_id string, n int")
    G.publish(old, root, "chunks", "r1")
    G.publish(new, root, "chunks", "r2")
    seen = lambda: sorted((r["document_id"], r["n"]) for r in G.active(spark, root, "chunks").collect())
    assert seen() == [("d1", 9), ("d2", 1)]
    G.publish(new, root, "chunks", "r2")
    assert seen() == [("d1", 9), ("d2", 1)]
    old.write.parquet(f"{root}/chunks/run_id=failed")  # no manifest: a run that did not end
    assert seen() == [("d1", 9), ("d2", 1)]
    docs = old.select("document_id").distinct()
    assert [r[0] for r in G.pending(docs, root, "chunks", "r2").collect()] == ["d2"]
    assert G.pending(docs, f"{root}/none", "chunks", "r2").count() == 2


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-" + b"0" * 100)
    rows = {r["filename"]: r["is_pdf"] for r in G.pdf_files(spark, str(tmp_path), largest=50).collect()}
    assert rows == {"a.PDF": True, "b.pdf": False}


def test_ingest_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    rows.coalesce(1).write.parquet(source)
    run = lambda: ingest(spark, source, rows.schema, target, checkpoint, lambda b: b.filter(F.col("k") > 0)).awaitTermination()
    run()
    run()
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(1, "z", 2), (-1, "no", 2)], rows.schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted((r["k"], r["v"]) for r in settled(spark, target, ["k"], "at").collect()) == [(1, "z"), (2, "b")]
