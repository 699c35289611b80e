"""Plan shapes that matter at scale."""

import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bankmail.operators import browse as W
from bankmail.operators import ingest as I
from bankmail.operators import joins
from bankmail.operators import search as Q
from bankmail.operators import spending as S
from bankmail.operators.joins import left_join
from bankmail.plans import reports as P
from bankmail.plans import sync as Y
from bankmail.session import CLEANUP, materialize, write
from bankmail.sources.derived import base, view
from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def shuffled(df) -> list[list[str]]:
    """Column names of every shuffle of the final plan; one that is read again counts once."""
    df.collect()
    found = []

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        else:
            for i in range(node.children().size()):
                walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_files(spark):
    t = base(spark, SF, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("bank_name"), "o_totalprice", "o_orderdate"
    )
    shape = plan(t.filter(F.col("bank_name") == "F").select("id"))
    assert "EqualTo(o_orderstatus,F)" in shape and "o_totalprice" not in shape.split("ReadSchema")[1]


def test_null_keys_are_spread_over_partitions(spark, no_broadcast):
    left = spark.range(10_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = spark.range(1000).select(F.col("id").alias("r"), F.lit("v").alias("v"))
    joined = left_join(left, right, "k", "r", spread_by="id")
    assert re.search(r"Exchange hashpartitioning\(k#\d+L, __ls#\d+", plan(joined))
    assert joined.count() == 10_000 and joined.filter("v is not null").count() == 100
    left.createOrReplaceTempView("l")
    sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 10_000 or len(sizes) == 1  # AQE may merge small partitions into one


def test_hot_key_is_split_at_run_time(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.uuid().alias("pad"))
        right = spark.range(60_000).select(F.col("id").alias("r"), (F.col("id") * 2).alias("v"))
        joined = left_join(left, right, "k", "r", spread_by="id").select("id", "v", "pad")
        joined.write.format("noop").mode("overwrite").save()
        assert "skew=true" in final_plan(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_hot_bank_is_cut_before_the_shuffle(spark):
    shape = plan(W.first_offers_per_bank(view(spark, SF, "offers")))
    below = shape.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_sums_are_partial_before_the_shuffle(spark):
    shape = plan(S.by_bank(view(spark, SF, "transactions")))
    assert "partial_sum" in shape.split("Exchange hashpartitioning")[1]


def test_top_rows_without_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(W.recent_emails(view(spark, SF, "emails")))


def test_offer_lookup_never_shuffles_the_mails(spark, no_broadcast):
    mails = view(spark, SF, "offer_emails")
    shape = final_plan(W.recent_offers(view(spark, SF, "offers"), mails, limit=10))
    assert "SortMergeJoin" not in shape and "BroadcastHashJoin" in shape


def test_report_scans_the_transactions_once_for_all_groups(spark):
    report = P.spending_report(view(spark, SF, "transactions"), view(spark, SF, "emails"))
    assert final_plan(report).count("ReusedExchange") >= 3


def test_new_rows_shuffle_once_however_many_keys_are_stored(spark, no_broadcast, tmp_path):
    rows = spark.range(600).select(
        F.lit("a").alias("account"), F.lit("f").alias("folder"), (F.col("id") % 500).cast("string").alias("message_id"), F.col("id").alias("received_date"),
        F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 50).alias("body_text"),
    )
    rows.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    new = I.insert_new(batch, batch.filter("message_id < '3'").select(*I.KEY))
    assert sum("body_text" in columns for columns in shuffled(new)) == 1
    want = sorted(k for k in range(500) if str(k) >= "3")
    assert sorted(int(r.message_id) for r in new.collect()) == want and all(r.received_date == int(r.message_id) for r in new.collect())


def test_rows_of_single_keys_do_not_shuffle_where_keys_are_staged(spark, no_broadcast, tmp_path):
    rows = spark.range(600).select(
        F.lit("a").alias("account"), F.lit("f").alias("folder"), (F.col("id") % 500).cast("string").alias("message_id"), F.col("id").alias("received_date"),
        F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 50).alias("body_text"),
    )
    rows.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    stage = lambda df: materialize(df, "keys", str(tmp_path / f"keys-{len(list(tmp_path.iterdir()))}"))
    for least in ("0", "3"):
        stored = batch.filter(F.col("message_id") < least).select(*I.KEY)
        new = I.insert_new(batch, stored, stage=stage)
        # rows of stored keys meet them in a shuffle if Spark broadcasts nothing of itself
        assert sum("body_text" in columns for columns in shuffled(new)) == (0 if least == "0" else 1)
        assert sorted(map(str, new.collect())) == sorted(map(str, I.insert_new(batch, stored).collect()))


def test_keys_of_one_hash_are_told_apart_where_keys_are_staged(spark, tmp_path):
    # a NULL leaves a hash as it was
    batch = spark.createDataFrame([("a", None, 1), (None, "a", 2), (None, "a", 3), ("b", "c", 4)], "account string, folder string, at int")
    held = spark.createDataFrame([("a", None), ("b", "c")], "account string, folder string")
    stage = lambda df: materialize(df, "keys", str(tmp_path / f"keys-{len(list(tmp_path.iterdir()))}"))
    new = joins.first_per_key(batch, ["account", "folder"], [F.col("at")], held, stage)
    assert sorted(r.at for r in new.collect()) == [1, 2]


def test_a_staged_sync_keeps_only_the_labelled_mails(spark, tmp_path):
    mail = view(spark, SF, "raw_mail")
    none = spark.createDataFrame([], "account string, folder string, message_id string")
    out = Y.sync(mail, none, "2001-01-01 00:00:00", stage=True)
    assert [f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in out.folders] == ["labelled"]
    plain = Y.sync(mail, none, "2001-01-01 00:00:00")
    assert out.inserted.columns == plain.inserted.columns and out.inserted.exceptAll(plain.inserted).isEmpty() and out.inserted.count() == plain.inserted.count()
    out.release()


def test_indexing_shuffles_a_row_per_document_and_group_of_folders(spark, tmp_path):
    mails = view(spark, SF, "emails")
    rows = Q.bucketed_postings(mails)
    assert not any({"token", "pos"} & set(columns) for columns in shuffled(rows))
    got = rows.filter("token <> ''").select(*Q.postings(mails).columns)
    assert got.exceptAll(Q.postings(mails)).isEmpty() and got.count() == Q.postings(mails).count()
    assert rows.filter("token = '' and field = ''").count() == mails.count()


def test_writes_leave_no_shuffle_behind(spark, tmp_path):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    known = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = known()
    write(spark.range(1000).withColumn("k", F.col("id") % 5).hint("rebalance", F.col("k")), str(tmp_path / "t"), ("k",))
    time.sleep(1)
    assert not known() - before and spark.conf.get(CLEANUP) == "false"
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000 and all("zstd" in f for f in spark.read.parquet(str(tmp_path / "t")).inputFiles())


def test_the_outputs_of_a_sync_label_its_mails_once(spark):
    mail = view(spark, SF, "raw_mail")
    none = spark.createDataFrame([], "account string, folder string, message_id string")
    out = Y.sync(mail, none, "2001-01-01 00:00:00", stage=True)
    for rows in (out.processed.classified, out.processed.transactions, out.processed.offers):
        assert all("/labelled-" in f for f in rows.inputFiles()) and rows.count() > 0
    out.release()


def test_whole_sync_reads_the_landed_mail_once_for_its_counts(spark):
    assert plan(entry.queries()["c2_whole_sync"](spark, SF)).count("orders.parquet") == 1


@pytest.mark.parametrize("narrow", [joins.NARROW, 0])
def test_reindexing_documents_shuffles_no_words(spark, no_broadcast, monkeypatch, narrow):
    monkeypatch.setattr(joins, "NARROW", narrow)
    found = shuffled(entry.queries()["s17_reindexed_documents"](spark, SF))
    assert found and not any({"token", "pos"} & set(columns) for columns in found)
    # few marks go to the texts, many meet them in a shuffle
    assert any({"body_text", "text"} & set(columns) for columns in found) == (narrow == 0)
