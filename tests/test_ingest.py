"""Duplicates, marks, tables on disk, the sync as a stream."""

import pytest
from pyspark.sql import functions as F

from bankmail import schemas
from bankmail.caps import PARITY
from bankmail.operators import ingest as I
from bankmail.operators import maintain as M
from bankmail.plans import sync as Y
from bankmail.sources import mail as S
from bankmail.sources import tables
from bankmail.streaming.sync import failed_run, into_tables

AS_OF = "2025-06-20 00:00:00"


def raw(spark, n=40, start=0):
    rows = [
        (f"user{i % 2}@x", "INBOX" if i % 3 else "Bulk Mail", f"m{i // 2}", ["a@hdfcbank.net", "b@kotak.com", "c@shop.example"][i % 3],
         ["Debit Alert", "Offer"][i % 2], [f"Rs.{100 + i} debited via UPI on 12/06/2025", "Get 5% cashback on every order you place"][i % 2], None,
         f"2025-06-{1 + i % 15:02d}T10:{i % 60:02d}:00+05:30", 0)
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, schemas.RAW_MAIL_SCHEMA)


def records(mail):
    return I.email_records(I.with_bank(S.dated(mail)))


def keys(df):
    return sorted(tuple(r) for r in df.select("account", "folder", "message_id", "received_date").collect())


def none_stored(spark):
    return spark.createDataFrame([], "account string, folder string, message_id string")


def test_inserting_twice_is_inserting_once(spark):
    batch = records(raw(spark))
    first = I.insert_new(batch, none_stored(spark))
    assert I.insert_new(batch, first).count() == 0
    assert keys(I.insert_new(batch.unionByName(batch), none_stored(spark))) == keys(first)


@pytest.mark.parametrize("cut", [1, 17, 39])
def test_any_split_gives_the_same_keys(spark, cut):
    whole = I.insert_new(records(raw(spark)), none_stored(spark))
    a = I.insert_new(records(raw(spark, cut)), none_stored(spark))
    b = I.insert_new(records(raw(spark, 40 - cut, cut)), a)
    assert sorted(k[:3] for k in keys(a.unionByName(b))) == sorted(k[:3] for k in keys(whole))


def test_a_key_with_a_null_is_compared_but_never_stored(spark):
    rows = [("a", None, 2, "p"), ("a", None, 1, "q"), ("b", "x", 1, "r"), ("b", "x", 0, "s"), ("c", "x", 0, "t"), ("d", "y", 0, "u"), ("d", "y", 0, "u")]
    batch = spark.createDataFrame(rows, "account string, folder string, at int, body_text string")
    stored = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x"), ("e", "x")], "account string, folder string")
    new = I.insert_new(batch, stored, key=["account", "folder"], order=["at"], required=["account"])
    assert sorted(map(tuple, new.collect()), key=repr) == [("a", None, 1, "q"), ("c", "x", 0, "t"), ("d", "y", 0, "u")]


def test_key_columns_are_a_choice(spark):
    batch = records(raw(spark))
    by_uid = I.insert_new(batch, none_stored(spark), key=["message_id"])
    assert by_uid.count() == batch.select("message_id").distinct().count()


def test_ids_are_stable_and_distinct(spark):
    ids = [r.id for r in I.insert_new(records(raw(spark)), none_stored(spark)).select("id").collect()]
    again = [r.id for r in I.insert_new(records(raw(spark).repartition(7)), none_stored(spark)).select("id").collect()]
    assert sorted(ids) == sorted(again) and len(set(ids)) == len(ids)


def test_missing_required_values(spark):
    batch = records(raw(spark)).withColumn("sender", F.when(F.col("bank_name") == "HDFC", F.col("sender")))
    kept = I.insert_new(batch, none_stored(spark), required=["message_id", "sender"])
    assert {r.bank_name for r in kept.collect()} == {"HDFC"}
    assert I.rejected(batch, ["sender"]).first().rejected == batch.filter("bank_name <> 'HDFC'").count()


def test_late_mail_needs_a_lookback(spark):
    mail = S.dated(raw(spark))
    marks = I.high_water_mark(mail)
    at_mark = I.newer_than_mark(mail, marks, AS_OF)
    with_lookback = I.newer_than_mark(mail, marks, AS_OF, lookback=30)
    assert with_lookback.count() == mail.count() > at_mark.count() > 0
    first = I.newer_than_mark(mail, marks.limit(0), "2025-06-14 12:00:00")
    assert first.filter("received_date < timestamp_ntz'2025-06-11 00:00:00'").count() == 0 < first.count()


def test_no_date_takes_as_of(spark):
    mail = raw(spark, 2).withColumn("date", F.lit(None).cast("string"))
    assert {str(r[0]) for r in S.dated(mail, AS_OF).select("received_date").collect()} == {AS_OF}


def test_tables_append_rewrite_reset(spark, tmp_path):
    root = str(tmp_path)
    tables.reset_tables(spark, root, list(schemas.TABLES.values()))
    result = Y.sync(raw(spark), tables.read(spark, root, schemas.EMAILS), AS_OF)
    for _ in range(2):  # the same batch again changes nothing
        Y.store(spark, result, root, "b1", AS_OF)
    stored = tables.read(spark, root, schemas.EMAILS)
    n = result.inserted.count()
    assert stored.count() == n > 0
    assert tables.read(spark, root, schemas.TRANSACTIONS).count() == result.processed.transactions.count() > 0
    assert tables.read(spark, root, schemas.OFFERS).count() == result.processed.offers.count() > 0
    runs = M.sync_runs(tables.read(spark, root, schemas.SYNC_EVENTS)).collect()
    assert {r.status for r in runs} == {"success"} and sum(r.emails_fetched for r in runs) == n

    labels = stored.select("id", F.lit("OTHER").alias("email_type"))
    tables.rewrite(spark, root, schemas.EMAILS, lambda rows: M.set_email_type(rows, labels), F.col("received_month") == "2025-06")
    assert {r.email_type for r in tables.read(spark, root, schemas.EMAILS).collect()} == {"OTHER"}
    assert tables.read(spark, root, schemas.EMAILS).count() == n

    # all rows of a folder gone: the folder goes too, and the children follow
    tables.rewrite(spark, root, schemas.EMAILS, lambda rows: rows.limit(0))
    left = tables.read(spark, root, schemas.EMAILS)
    assert left.count() == 0
    tables.rewrite(spark, root, schemas.TRANSACTIONS, lambda rows: M.prune_orphans(rows, left))
    assert tables.read(spark, root, schemas.TRANSACTIONS).count() == 0

    tables.reset_tables(spark, root, list(schemas.TABLES.values()))
    assert all(tables.read(spark, root, t).count() == 0 for t in schemas.TABLES.values())


def test_stream_equals_batch(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "tables")
    tables.reset_tables(spark, root, list(schemas.TABLES.values()))
    mail = raw(spark)
    for i in range(2):
        raw(spark, 20, 20 * i).coalesce(1).write.mode("append").parquet(landing)
    raw(spark, 5, 10).coalesce(1).write.mode("append").parquet(landing)  # delivered again
    for _ in range(2):  # the second start finds nothing new
        stream = S.stream_mail(spark, landing, max_files=1)
        into_tables(stream, root, str(tmp_path / "checkpoint"), AS_OF).awaitTermination()
    batch = Y.sync(mail, none_stored(spark), AS_OF)
    stored = tables.read(spark, root, schemas.EMAILS)
    assert sorted(k[:3] for k in keys(stored)) == sorted(k[:3] for k in keys(batch.inserted))
    assert tables.read(spark, root, schemas.TRANSACTIONS).count() == batch.processed.transactions.count()
    failed_run(spark, root, "b9", "Missing", AS_OF, "[NONEXISTENT] no such folder")
    assert tables.read(spark, root, schemas.SYNC_EVENTS).filter("status = 'skipped'").count() == 1


def test_ocr_edges(spark):
    texts = [("m", 0, "x" * 10), ("m", 1, "y" * 11), ("m", 2, "z" * 501), ("m", 5, "sixth image text"), ("n", 0, "")]
    df = spark.createDataFrame(texts, "email_id string, pos int, text string")
    merged = {r.id: r for r in M.merged_ocr(df, PARITY.images, PARITY.image_min, PARITY.image_chars).collect()}
    assert {r.id: r.n_texts for r in M.merged_ocr(df).collect()} == {"m": 4}
    assert set(merged) == {"m"} and merged["m"].text == "y" * 11 + "\n" + "z" * 500 and merged["m"].n_texts == 2
    image = '<img src="http://a/1.png">'
    mails = spark.createDataFrame(
        [("m", None, image, True), ("k", "Hi", "", True), ("q", "Hi", image, False)], "id string, body_text string, body_html string, vision_needed boolean"
    )
    out = Y.merge_ocr(mails, df, PARITY)
    rows = {r.id: r for r in out.emails.collect()}
    assert rows["m"].body_text == "\n[VISION EXTRACTED]\n" + merged["m"].text
    assert rows["k"].body_text == rows["q"].body_text == "Hi" and not any(r.vision_needed for r in rows.values())
    assert tuple(out.summary().first()) == (1, 2, 1)


def test_batch_run_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.reset_tables(spark, root, list(schemas.TABLES.values()))

    def state():
        return [sorted(map(str, tables.read(spark, root, t).collect())) for t in schemas.TABLES.values()]

    Y.sync_batch(spark, raw(spark), root, "b:1", AS_OF)
    once = state()
    Y.sync_batch(spark, raw(spark), root, "b:1", AS_OF)
    assert state() == once and all(once)
    Y.sync_batch(spark, raw(spark, 4), root, "b:1", AS_OF)  # delivered smaller: the batch is what it says now
    assert tables.read(spark, root, schemas.EMAILS).count() == Y.sync(raw(spark, 4), none_stored(spark), AS_OF).inserted.count()


def test_a_cluster_needs_a_shared_folder(spark):
    from bankmail.session import work_dir

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Elsewhere, "x")
    assert "bankmail" in work_dir(spark, "x")


def test_records_are_made_once_and_compared_as_written(spark):
    """Neither the duplicate check nor the choice of stored folders makes the texts again."""
    from bankmail.catalog import ingest as G
    from compare import TESTDATA

    made = lambda df: "EvalPython" in df._jdf.queryExecution().executedPlan().toString()
    sf, seen = f"{TESTDATA}/sf0.001", []
    assert made(G.records(spark, sf)) and not made(G.inserted(spark, sf))
    Y.sync(raw(spark), lambda records: seen.append(made(records)) or none_stored(spark), AS_OF, stage=True).release()
    assert seen == [False]
