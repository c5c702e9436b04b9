"""Stored results, the vector collection, mergeable counts, written workbooks."""

import os
import re
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from periodix.operators import aggregates as agg
from periodix.operators import retrieval as R
from periodix.plans import store as ST
from periodix.sources import workbooks as WB
from periodix.sources.sinks import read_vector_collection, write_vector_collection
from periodix.sources.xlsx import read_filings


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="periodix-store-")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_replaces_results_as_a_whole(spark, folder):
    first = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year INT, total DOUBLE")
    ST.publish({"market": first, "names": spark.createDataFrame([("a",)], "name STRING")}, folder)
    reader = ST.Store(spark, folder)
    before = reader.query("market", year=2001)
    ST.publish({"market": first.withColumn("total", F.col("total") * 10)}, folder)
    assert [r["total"] for r in before.collect()] == [2.0]  # began with the first version
    assert reader.table("names").count() == 1
    again = ST.Store(spark, folder)
    assert [r["total"] for r in again.query("market", year=2001).collect()] == [20.0]
    assert again.query("market", year=1999).count() == 0


def test_half_written_version_is_never_seen(spark, folder):
    good = spark.createDataFrame([(2000, 1.0)], "year INT, total DOUBLE")
    ST.publish({"market": good}, folder)
    fails = good.select("year", F.raise_error(F.lit("broken")).cast("double").alias("total"))
    with pytest.raises(Exception, match="broken"):
        ST.publish({"market": good, "other": fails}, folder)
    assert len(ST.versions(spark, folder)) == 1 and ST.Store(spark, folder).query("market").count() == 1


def test_year_filter_reads_one_partition(spark, folder):
    ST.publish({"market": spark.range(70).select((F.col("id") % 7 + 2000).cast("int").alias("year"), "id")}, folder)
    plan = _plan(ST.Store(spark, folder).query("market", year=2003))
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ = 2003\)\]", plan) and "Exchange" not in plan


def test_prune_keeps_the_newest(spark, folder):
    df = spark.createDataFrame([(1,)], "x INT")
    names = [ST.publish({"t": df}, folder) for _ in range(3)]
    assert ST.prune(spark, folder, keep=1) == names[1::-1]
    assert os.listdir(f"{folder}/versions") == [names[2]] and ST.Store(spark, folder).table("t").count() == 1


def test_empty_store(spark, folder):
    with pytest.raises(ValueError):
        ST.Store(spark, folder)
    with pytest.raises(ValueError):
        ST.publish({}, folder)


def _collection(spark, n, scale):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
        F.array(F.col("id") * scale, F.lit(1.0)).cast("array<float>").alias("embedding"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))


def test_collection_is_replaced_and_kept_on_empty_writes(spark, folder):
    with pytest.raises(ValueError):
        read_vector_collection(spark, folder)
    assert not write_vector_collection(_collection(spark, 0, 1), folder)
    assert write_vector_collection(_collection(spark, 30, 1), folder, buckets=4)
    old = read_vector_collection(spark, folder, buckets=4)
    assert write_vector_collection(_collection(spark, 20, 2), folder, buckets=4)
    assert not write_vector_collection(_collection(spark, 0, 1), folder)
    new = read_vector_collection(spark, folder, buckets=4)
    assert (old.count(), new.count()) == (30, 20)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid INT, vec ARRAY<DOUBLE>")
    assert R.cosine_topk(new, asked, k=1, doc_id="id").first()["doc_id"] == "19"


def test_collection_joins_by_its_buckets(spark, folder):
    write_vector_collection(_collection(spark, 50, 1), folder, buckets=4)
    stored = read_vector_collection(spark, folder, buckets=4)
    plan = _plan(stored.join(stored.select("id", F.length("text").alias("n")), "id"))
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    name = f"collection_{ST.versions(spark, folder)[0]}"
    spark.sql(f"DROP TABLE {name}")  # as another session: known by its files only
    assert read_vector_collection(spark, folder, buckets=4).count() == 50


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
def test_sketches_merge_within_their_error(spark, n):
    df = spark.range(n * 3).select((F.col("id") % 4).alias("quarter"), (F.col("id") % 4 % 2).alias("year"),
                                   F.concat(F.lit("f"), (F.col("id") % max(n, 1)).cast("string")).alias("mfo_name"))
    sketches = agg.entity_sketches(df)
    assert sketches.count() == min(4, 3 * n)
    got = agg.sketch_counts(sketches).first()["mfo_count"] or 0
    assert abs(got - n) <= max(1, n * agg.SKETCH_ERROR) if n else got == 0


def test_workbooks_round_trip(spark, folder):
    rows = [(str(k), f"Firm & <{k}>", 10.5 * k, None, 9.25 * k, 1.0, None, 0.125, "1.50", "2.00", "3.10", "new",
             f"1999-{m:02}-01", 1999, "filings_1999_h1.xlsx") for k in range(1, 8) for m in (1, 4)]
    rows += [(str(k), f"Old {k}", 5.0, 4.6, None, None, None, None, "7", "8.00", None, "old", "1996-01-01", 1996,
              "filings_1996_h1.xlsx") for k in range(1, 4)]
    schema = ("no STRING, mfo_name STRING, assets DOUBLE, net_loans DOUBLE, portfolio_gross DOUBLE, del_31_60 DOUBLE, "
              "del_61_90 DOUBLE, del_90_plus DOUBLE, liabilities STRING, equity STRING, profit STRING, format STRING, "
              "quarter STRING, year INT, file STRING")
    parsed = spark.createDataFrame(rows, schema)
    made = {r["file"]: r["n_sheets"] for r in WB.write_workbooks(parsed, folder, firms=4).collect()}
    assert made == {"filings_1999_h1_0000.xlsx": 2, "filings_1999_h1_0001.xlsx": 2, "filings_1996_h1_0000.xlsx": 1}
    filings, errors = read_filings(spark, folder)
    got = {(r["no"], r["quarter"]): r for r in filings.collect()}
    assert len(got) == len(rows)
    assert got["6", "2019-04-01"]["mfo_name"] == "Firm & <6>" and got["6", "2019-04-01"]["profit"] == "3.10"
    assert got["2", "2016-01-01"]["portfolio_gross"] == pytest.approx(5.0) and got["2", "2016-01-01"]["equity"] == "8.00"
    said = {(r["file"], r["sheet"]): r["error"].split(":")[0] for r in errors.collect()}
    assert said == {**{(f"{p}filings_{y}_h1_0000.xlsx", None): "unreadable workbook" for p in ("~$", "cut_") for y in (1996, 1999)},
                    ("torn_filings_1999_h1_0000.xlsx", "01.01.2019"): "unreadable sheet",
                    ("torn_filings_1996_h1_0000.xlsx", "01.01.2016"): "unreadable sheet"}
    assert not [f for f in os.listdir(folder) if f.startswith("_")]
    assert zipfile.is_zipfile(f"{folder}/filings_1999_h1_0001.xlsx")
