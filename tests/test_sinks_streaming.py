"""Sinks (S6-S8), the result registry (A6, P23, P24), streaming ingest."""

import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from periodix.operators import encoding as EN
from periodix.operators.normalise import dedupe_filings
from periodix.plans import results as RS
from periodix.sources import panel
from periodix.sources.sinks import export_csv, save_results
from periodix.streaming.ingest import read_ingested, start_ingest
from tests.conftest import SF_SMALL
from tests.test_ingest import NEW_SHEET, OLD_SHEET
from tests.xlsx_util import write_xlsx


def test_registry_save_and_export(spark):
    res = RS.compute_all(RS.prepare(panel.filings_panel(spark, SF_SMALL)))
    assert set(res) >= {"raw", "yearly_market", "yearly_leaders", "yearly_non_leaders", "top_mfos"}
    assert RS.preview(res, "raw").count() == 100
    assert RS.preview(res, "top_mfos").count() == 20
    one = RS.structured_query(res, "yearly_market", year=2000).collect()
    assert len(one) == 1 and one[0]["year"] == 2000
    out = tempfile.mkdtemp(prefix="periodix-out-")
    paths = save_results({k: res[k] for k in ("yearly_market", "top_mfos")}, out)
    assert any(d.startswith("year=") for d in os.listdir(paths["yearly_market"]))
    back = spark.read.parquet(paths["yearly_market"])
    assert back.count() == 7
    csv = os.path.join(out, "csv")
    export_csv(res["yearly_market"], csv)
    assert spark.read.option("header", True).csv(csv).count() == 7


def test_dedupe_keeps_latest_file(spark):
    rows = [("A", "2023-01-01", 1.0, "a.xlsx"), ("A", "2023-01-01", 2.0, "b.xlsx"),
            ("B", "2023-01-01", 3.0, "a.xlsx")]
    df = spark.createDataFrame(rows, "mfo_name STRING, quarter STRING, assets DOUBLE, file STRING")
    got = {(r["mfo_name"], r["assets"], r["file"]) for r in dedupe_filings(df).collect()}
    assert got == {("A", 2.0, "b.xlsx"), ("B", 3.0, "a.xlsx")}


def test_index_documents(spark):
    docs = spark.createDataFrame([("summary_0", "Market Overview"), ("summary_1", "2024: 3 MFOs")],
                                 "id STRING, text STRING")
    path = os.path.join(tempfile.mkdtemp(prefix="periodix-vec-"), "coll")
    coll = EN.index_documents(docs, path)
    rows = {r["id"]: r for r in coll.collect()}
    assert len(rows["summary_0"]["embedding"]) == 64
    assert abs(sum(x * x for x in rows["summary_1"]["embedding"]) - 1.0) < 1e-5


def test_streaming_ingest(spark):
    src = tempfile.mkdtemp(prefix="periodix-in-")
    out = tempfile.mkdtemp(prefix="periodix-sout-")
    ckpt = tempfile.mkdtemp(prefix="periodix-sckpt-")
    stage = tempfile.mkdtemp(prefix="periodix-stage-")
    write_xlsx(os.path.join(stage, "a.xlsx"), {"01.04.2023": NEW_SHEET})
    shutil.move(os.path.join(stage, "a.xlsx"), os.path.join(src, "a.xlsx"))
    q = start_ingest(spark, src, out, ckpt)
    q.awaitTermination(120)
    write_xlsx(os.path.join(stage, "b.xlsx"), {"01.01.2020": OLD_SHEET})
    shutil.move(os.path.join(stage, "b.xlsx"), os.path.join(src, "b.xlsx"))
    time.sleep(1)
    q = start_ingest(spark, src, out, ckpt)  # restart from the checkpoint: only b.xlsx is new
    q.awaitTermination(120)
    got = {(r["file"], r["quarter"], r["mfo_name"]) for r in read_ingested(spark, out).collect()}
    assert got == {("a.xlsx", "2023-04-01", "A"), ("b.xlsx", "2020-01-01", "A")}
    assert read_ingested(spark, out).select("batch_id").distinct().count() == 2
