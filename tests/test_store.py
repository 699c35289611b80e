"""Commits, changes merged on read, marks, the stored search index, folders that fail alone."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from bankmail.operators import ingest as I
from bankmail.operators import maintain as M
from bankmail.operators import search as Q
from bankmail.plans import sync as Y
from bankmail.plans.index import SearchIndex
from bankmail.schemas import CHANGES, EMAIL_CHANGES, EMAILS, INDEX_TABLES, KEY_FILTERS, MARKS, OFFERS, RAW_MAIL_SCHEMA, SYNC_EVENTS, TABLES, TRANSACTIONS
from bankmail.sources import commits, tables
from bankmail.sources.commits import current
from bankmail.sources.tables import Commit
from bankmail.streaming.sync import Folder, sync_folders

from test_ingest import AS_OF, none_stored, raw

ALL = [*TABLES.values(), MARKS, *INDEX_TABLES]


@pytest.fixture()
def root(spark, tmp_path):
    folder = str(tmp_path / "tables")
    tables.reset_tables(spark, folder, list(TABLES.values()))
    return folder


def state(spark, root):
    return [sorted(str(r) for r in tables.read(spark, root, t).collect()) for t in ALL]


def on_the_fly(spark, root, **terms):
    mails = tables.read(spark, root, EMAILS)
    return sorted((r.doc_id, round(r["rank"], 9)) for r in Q.search(Q.postings(mails), Q.doc_lengths(mails), limit=None, **terms).collect())


def from_index(spark, root, **terms):
    return sorted((r.doc_id, round(r["rank"], 9)) for r in SearchIndex(spark, root).search(limit=None, **terms).collect())


TERMS = [{"any": ["cashback", "upi"], "none": ["offer"], "phrase": "debited via UPI"}, {"all": ["zebra"]}]
MORE_TERMS = [{"all": ["debited"]}, {"prefix": "deb"}, {"near": (["rs", "upi"], 5)}]


def same_hits(spark, root, more=()):
    for terms in [*TERMS, *more]:
        assert from_index(spark, root, **terms) == on_the_fly(spark, root, **terms), terms
    lengths = SearchIndex(spark, root).lengths()
    assert lengths.count() == lengths.select("doc_id").distinct().count() == tables.read(spark, root, EMAILS).count()


def test_a_batch_is_visible_at_once_or_not_at_all(spark, root, monkeypatch):
    Y.sync_batch(spark, raw(spark, 6), root, "b1", AS_OF)
    before = state(spark, root)
    plain = Commit.add
    result = Y.sync(raw(spark, 30), tables.read(spark, root, EMAILS), AS_OF, stage=True)
    for last in (0, 3, 8):  # before the first write, between two, before the last one
        writes = []

        def dying(self, df, table, last=last, writes=writes):
            if len(writes) == last:
                raise RuntimeError("killed")
            writes.append(table.name)
            plain(self, df, table)

        monkeypatch.setattr(Commit, "add", dying)
        with pytest.raises(RuntimeError, match="killed"):
            Y.store(spark, result, root, "b2", AS_OF)
        assert len(writes) == last and state(spark, root) == before
    monkeypatch.setattr(Commit, "add", plain)
    assert commits.vacuum(spark, root)  # what the killed jobs left
    Y.sync_batch(spark, raw(spark, 30), root, "b2", AS_OF)
    whole = Y.sync(raw(spark, 30), none_stored(spark), AS_OF).inserted.count()
    assert tables.read(spark, root, EMAILS).count() == whole
    assert commits.vacuum(spark, root) == []
    same_hits(spark, root)


def test_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEEP", 3)
    root, schema = str(tmp_path / "t"), TRANSACTIONS.schema
    row = lambda k: spark.createDataFrame([(f"{k}", None, "HDFC", None, "INR", None, None, None, None, None, None, None, f"{k}")], schema)
    assert current(spark, root).version == 0 and tables.read(spark, root, TRANSACTIONS).count() == 0
    for k in range(6):
        tables.append(row(k), root, TRANSACTIONS, "same")
    assert [r.id for r in tables.read(spark, root, TRANSACTIONS).collect()] == ["5"]
    assert current(spark, root).version == 6 and current(spark, root).sequence("same") == 1 and current(spark, root).sequence("new") == 7
    assert len(commits.children(spark, f"{root}/_commits")) <= 7  # with checksums of a local file system
    assert len(commits.children(spark, f"{root}/transactions")) == 4  # the live one, and those kept for running readers
    threads = [threading.Thread(target=lambda k=k: tables.append(row(k), root, TRANSACTIONS, f"b{k}")) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tables.read(spark, root, TRANSACTIONS).count() == 6 and current(spark, root).version == 11
    tables.merge(spark, root, TRANSACTIONS)
    assert len(current(spark, root).folders("transactions")) == 1 and tables.read(spark, root, TRANSACTIONS).count() == 6


def test_a_taken_version_is_not_overwritten(spark, tmp_path, monkeypatch):
    root, plain, raced = str(tmp_path / "t"), commits._put, []

    def late(spark, root, new):
        if not raced:  # another driver was faster
            raced.append(plain(spark, root, commits.State(new.version, {"other": {"w=1": {"batch": "x", "seq": 1}}})))
        return plain(spark, root, new)

    monkeypatch.setattr(commits, "_put", late)
    done = commits.commit(spark, root, lambda s: {"mine": {"w=2": {"batch": "y", "seq": 1}}})
    assert done.version == 2 and set(done.tables) == {"other", "mine"}
    assert set(json.loads((tmp_path / "t" / "_commits" / f"{2:020d}.json").read_text())["tables"]) == {"other", "mine"}


def test_changes_are_merged_and_folded(spark, root):
    Y.sync_batch(spark, raw(spark), root, "b1", AS_OF)
    mails = {r.id: r for r in tables.read(spark, root, EMAILS).collect()}
    a, b, c, d = sorted(mails)[:4]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    files = set(current(spark, root).folders("emails"))
    Y.label_emails(spark, root, frame([(a, "OTHER", 1), (a, "OTP_SECURITY_ALERT", 2), (b, "OTHER", 1)], "id string, email_type string, n int"), "c1", order="n")
    Y.label_emails(spark, root, frame([(b, "REGULATORY_KYC_NOTICE")], "id string, email_type string"), "c2")
    Y.append_texts(spark, root, frame([(c, "zebra one"), (c, "zebra two")], "id string, text string"), "c3")
    Y.append_texts(spark, root, frame([(c, "and more")], "id string, text string"), "c4")
    Y.append_texts(spark, root, frame([(c, "zebra one")], "id string, text string"), "c3")  # run again: not appended again
    Y.clear_ocr_flags(spark, root, frame([(c,)], "id string"), "c5")
    Y.label_emails(spark, root, frame([(a, "OTHER", 1), (a, "OTP_SECURITY_ALERT", 2), (b, "OTHER", 1)], "id string, email_type string, n int"), "c1", order="n")
    children = {t.name: tables.read(spark, root, t).filter(F.col("email_id") == d).count() for t in (TRANSACTIONS, OFFERS)}
    Y.delete_emails(spark, root, frame([(d,)], "id string"), "c6")
    assert set(current(spark, root).folders("emails")) == files  # no mail was written again

    def holds():
        now = {r.id: r for r in tables.read(spark, root, EMAILS).collect()}
        assert set(now) == set(mails) - {d}
        assert now[a].email_type == "OTP_SECURITY_ALERT" and now[b].email_type == "REGULATORY_KYC_NOTICE"  # a replay keeps its place
        assert now[c].body_text == mails[c].body_text + "\n[VISION EXTRACTED]\nzebra one\n[VISION EXTRACTED]\nand more" and not now[c].vision_needed
        assert all(now[k].asDict() == mails[k].asDict() for k in set(now) - {a, b, c})
        for t in (TRANSACTIONS, OFFERS):
            assert tables.read(spark, root, t).filter(F.col("email_id") == d).count() == 0
        same_hits(spark, root)

    assert sum(children.values()) == 1
    holds()
    tables.fold(spark, root, EMAILS)
    left = current(spark, root)
    assert not left.folders(EMAIL_CHANGES.name) and set(left.folders("emails")) & files == set() or len(files) > 1
    holds()
    Y.sync_batch(spark, raw(spark), root, "b2", AS_OF)  # a deleted mail can come again
    assert set(mails) == {r.id for r in tables.read(spark, root, EMAILS).select("id").collect()}
    same_hits(spark, root)


def test_a_mail_deleted_and_stored_again_before_changes_are_folded(spark, root):
    Y.sync_batch(spark, raw(spark, 4), root, "b1", AS_OF)
    ids = tables.read(spark, root, EMAILS).select("id")
    n = ids.count()
    Y.delete_emails(spark, root, ids, "c1")
    assert tables.read(spark, root, EMAILS).count() == 0 == len(from_index(spark, root, all=["debited"]))
    Y.sync_batch(spark, raw(spark, 4), root, "b2", AS_OF)
    assert tables.read(spark, root, EMAILS).count() == n == tables.read(spark, root, TRANSACTIONS).count() + tables.read(spark, root, OFFERS).count()
    same_hits(spark, root)
    tables.fold(spark, root, EMAILS)
    assert tables.read(spark, root, EMAILS).count() == n


def test_one_word_reads_one_bucket(spark, root):
    for k in range(2):
        Y.sync_batch(spark, raw(spark, 20, 20 * k), root, f"b{k}", AS_OF)
    index = SearchIndex(spark, root)
    same_hits(spark, root, MORE_TERMS)
    rows = index.postings().filter(F.col("bucket").isin(Q.bucket(F.lit("debited"))))
    assert rows.filter("token = 'debited'").count() > 0
    hits = index.search(all=["debited"])
    scans = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "token" in line]
    number = spark.range(1).select(Q.bucket(F.lit("debited"))).first()[0]
    assert scans and all("PartitionFilters" in line and f"{number})" in line for line in scans)
    buckets = {f.split("/")[1] for f in current(spark, root).folders("index_postings")}
    read = {p.split("/")[-2] for p in (r[0] for r in rows.select(F.input_file_name()).distinct().collect())}
    assert read == {f"bucket={number}"} and len(buckets) > 5
    index.compact()
    assert len({f.split("/")[0] for f in current(spark, root).folders("index_postings")}) == 1
    same_hits(spark, root)
    Y.tidy(spark, root, most=0)
    same_hits(spark, root)
    tables.reset_tables(spark, root, list(TABLES.values()))
    assert all(tables.read(spark, root, t).count() == 0 for t in ALL) and from_index(spark, root, all=["debited"]) == []


def test_marks_need_no_mail(spark, root):
    for k in range(3):
        Y.sync_batch(spark, raw(spark, 14, 13 * k), root, f"b{k}", AS_OF)
    marks = Y.marks(spark, root)
    assert "/emails/" not in marks._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, marks.collect())) == sorted(map(tuple, I.high_water_mark(tables.read(spark, root, EMAILS)).collect()))


def test_folders_fail_alone(spark, root, tmp_path):
    mail, folders = raw(spark, 60), []
    for account, name in (("user0@x", "INBOX"), ("user1@x", "INBOX"), ("user1@x", "Bulk Mail")):
        path = str(tmp_path / f"{account} {name}")
        mail.filter((F.col("account") == account) & (F.col("folder") == name)).coalesce(1).write.parquet(path)
        folders.append(Folder(account, name, path))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "x.parquet").write_text("this is no Parquet file")
    folders[1:1] = [Folder("user0@x", "Broken", str(broken)), Folder("user9@x", "Gone", str(tmp_path / "gone"))]

    def run(name):
        return sync_folders(spark, folders, root, str(tmp_path / "checkpoints"), AS_OF, name, at_once=2)

    assert set(run("r1")) == {"user0@x/Broken", "user9@x/Gone"}
    readable = mail.filter("account = 'user0@x' and folder = 'INBOX' or account = 'user1@x'")
    expected = Y.sync(readable, none_stored(spark), AS_OF).inserted
    assert tables.read(spark, root, EMAILS).count() == expected.count() > 0
    runs = M.sync_runs(tables.read(spark, root, SYNC_EVENTS))
    found = {(r.account, r.folder): r for r in runs.collect()}
    assert {k: r.status for k, r in found.items()} == {
        ("user0@x", "INBOX"): "success", ("user1@x", "INBOX"): "success", ("user1@x", "Bulk Mail"): "success", ("user0@x", "Broken"): "failed", ("user9@x", "Gone"): "skipped",
    }
    assert [(r.account, r.folder) for r in M.first_errors(runs).collect()] == [("user0@x", "Broken")]
    assert found["user0@x", "Broken"].error and M.first_errors(runs).first().error == found["user0@x", "Broken"].error
    result = Y.sync(readable, none_stored(spark), AS_OF)
    summary = {r.account: r for r in I.account_summary(result.scanned, result.inserted, runs).collect()}
    assert summary["user0@x"].folders_failed == 1 and summary["user0@x"].errors[0].startswith("Broken: ") and summary["user0@x"].emails_fetched > 0
    assert summary["user1@x"].errors == [] and "user9@x" not in summary
    # the broken file is replaced; the folder goes on, the others find nothing new
    (broken / "x.parquet").unlink()
    mail.filter("account = 'user0@x' and folder = 'Bulk Mail'").coalesce(1).write.mode("append").parquet(str(broken))
    run("r2")
    assert tables.read(spark, root, EMAILS).filter("account = 'user0@x' and folder = 'Bulk Mail'").count() > 0
    same_hits(spark, root)


def test_every_table_with_changes_has_an_id():
    assert all("id" in TABLES[name].schema.names and {"id", "seq", "deleted"} <= set(t.schema.names) for name, t in CHANGES.items())


def test_models_are_asked_once(spark, root):
    from bankmail.plans import models as L

    def answer(texts):
        return ['{"category": "FUNDS_DEBITED_ALERT", "bank_or_platform": "X", "amount_inr": "12"}' if "cashback" in t else "no idea" for t in texts]

    def failing(texts):
        raise ValueError("down")

    models = L.Models(label=L.Model(answer), transaction=L.Model(failing, retries=1))
    for name in ("b1", "b1", "b2"):
        Y.sync_batch(spark, raw(spark, 12), root, name, AS_OF, models=models)
        replies = sorted(map(tuple, tables.read(spark, root, L.REPLIES).collect()))
        assert len(replies) == len({r[:2] for r in replies})
        if name == "b1":
            first = replies
    assert replies == first  # neither a replay nor a batch of known mails asks again
    mails = {r.id: r for r in tables.read(spark, root, EMAILS).collect()}
    assert all(r.email_type == "FUNDS_DEBITED_ALERT" for r in mails.values() if "cashback" in r.body_text)
    assert {r[0] for r in replies} == {"label", "transaction"}
    failed = L.failures(spark, root).collect()
    assert failed and all(r.kind == "transaction" and "down" in r.error for r in failed)
    amounts = {r.email_id: float(r.amount) for r in tables.read(spark, root, TRANSACTIONS).collect()}
    assert all(amounts[k] == 12 for k, r in mails.items() if "cashback" in r.body_text)  # the label's amount where no model read one
    # asked again, the model now answers
    works = L.Model(lambda texts: ['{"amount": "77"}'] * len(texts))
    done = L.process_with(spark, root, tables.read(spark, root, EMAILS), L.Models(L.Model(answer), works), again=True)
    read = {r.email_id: float(r.amount) for r in done.transactions.collect()}
    assert all(read[k] == 77 for k, r in mails.items() if "cashback" in r.body_text)


def test_day_sums_follow_the_mails(spark, root):
    from bankmail.operators import spending as S

    def same():
        whole = S.daily(tables.read(spark, root, TRANSACTIONS), tables.read(spark, root, EMAILS)).collect()
        kept = Y.day_trend(spark, root)
        assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in whole]
        assert "transactions" not in kept._jdf.queryExecution().executedPlan().toString()
        return whole

    for k in range(3):
        Y.sync_batch(spark, raw(spark, 14, 13 * k), root, f"b{k}", AS_OF)
    Y.sync_batch(spark, raw(spark, 14, 13), root, "b1", AS_OF)
    assert len(same()) > 3
    ids = tables.read(spark, root, TRANSACTIONS).limit(4).select(F.col("email_id").alias("id"))
    ids = spark.createDataFrame(ids.collect(), "id string")
    for _ in range(2):
        Y.delete_emails(spark, root, ids, "c1")
        same()
    tables.fold(spark, root, EMAILS)
    same()
    Y.rebuild_day_sums(spark, root)
    same()


def test_only_folders_that_may_hold_a_key_are_read(spark, root, monkeypatch):
    from bankmail.plans import keys as K

    days = [f"20{20 + k // 12:02d}-{1 + k % 12:02d}-03T10:00:00" for k in range(24)]
    rows = [(f"a{k}@x", "INBOX", f"u{k}", "a@hdfcbank.net", "Debit", "Rs.5 debited", None, d, 0) for k, d in enumerate(days)]
    mail = spark.createDataFrame(rows, RAW_MAIL_SCHEMA)
    for k in range(4):
        Y.sync_batch(spark, mail.filter(F.col("uid").isin(*[f"u{i}" for i in range(k, 24, 4)])), root, f"b{k}", AS_OF)
    assert len(current(spark, root).folders("emails")) == 24
    read, plain = [], tables.read

    def noted(spark, root, table, *a, **how):
        if table is EMAILS and "folders" in how:
            read.append(how["folders"])
        return plain(spark, root, table, *a, **how)

    monkeypatch.setattr(tables, "read", noted)
    again = mail.filter(F.col("uid").isin("u3", "u8")).unionByName(spark.createDataFrame([("new@x", "INBOX", "n1", "a@hdfcbank.net", "Debit", "Rs.9 debited", None, "2024-05-05T10:00:00", 0)], mail.schema))
    Y.sync_batch(spark, again, root, "b9", AS_OF)
    assert len(read[-1]) == 2 and {f.split("=")[-1] for f in read[-1]} == {"2020-04", "2020-09"}
    assert plain(spark, root, EMAILS).count() == 25
    # a folder without a filter is read in any case
    with Commit(spark, root, "by hand") as c:
        c.add(plain(spark, root, EMAILS).limit(0), KEY_FILTERS)
        c.drop(KEY_FILTERS, list(current(spark, root).folders("key_filters")))
    assert K.folders_with(spark, root, plain(spark, root, EMAILS).select(*I.KEY), I.KEY) is None
    Y.sync_batch(spark, mail, root, "b10", AS_OF)
    assert plain(spark, root, EMAILS).count() == 25


def test_filters_never_miss_a_key(spark, tmp_path):
    from bankmail.plans import keys as K

    root = str(tmp_path / "t")
    mails = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("account"), F.lit("f").alias("folder"), F.concat(F.lit("m"), "id").alias("message_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("received_month"),
        F.lit("s").alias("sender"), F.lit("x").alias("sender_domain"), F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("received_date"))
    with Commit(spark, root, "b") as c:
        c.add(mails, EMAILS)
        K.add_filters(c, mails, I.KEY)
    for k in (0, 1, 6, 4999):
        one = mails.filter(F.col("id") == str(k)).select(*I.KEY)
        assert f"received_month=m{k % 7}" in {f.split("/")[1] for f in K.folders_with(spark, root, one, I.KEY)}
    unknown = spark.range(40).select(F.lit("a").alias("account"), F.lit("f").alias("folder"), F.concat(F.lit("z"), "id").alias("message_id"))
    assert len(K.folders_with(spark, root, unknown, I.KEY)) <= 2
    assert K.folders_with(spark, root, unknown.limit(0), I.KEY) == set()


def test_folders_of_keys_are_exact_however_full_the_filters(spark, monkeypatch):
    import __spark_entry__ as entry
    from bankmail.plans import keys as K
    from compare import TESTDATA, difference

    monkeypatch.setattr(K, "PLACES", 1 << 10)
    name, sf = "j6_keys_of_known_folders", f"{TESTDATA}/sf0.001"
    assert difference(entry.queries()[name](spark, sf), entry.oracle_sql()[name], sf) is None


def test_stream_sums_are_repeatable_and_bounded(spark, tmp_path):
    from bankmail.streaming import trend as D

    landing, root = str(tmp_path / "landing"), str(tmp_path / "tables")
    rows = [(f"2025-06-{1 + k % 9:02d} 10:00:00", k, "debit" if k % 2 else "credit") for k in range(60)]
    frame = lambda part: spark.createDataFrame(part, "t string, n int, transaction_type string").select(F.col("t").cast("timestamp").alias("ts"), F.col("n").cast("decimal(18,2)").alias("amount"), "transaction_type")
    for k in range(6):
        frame(rows[10 * k : 10 * k + 10]).coalesce(1).write.mode("append").parquet(landing)
    stream = lambda: spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    D.into_day_sums(stream(), root, str(tmp_path / "c1"), "ts", folders=3).awaitTermination()
    assert len({v["batch"] for v in current(spark, root).folders("stream_day_sums").values()}) <= 4
    sums = {r.day: (float(r.debits), float(r.credits), r["count"]) for r in D.days(spark, root).collect()}
    for day in range(1, 10):
        own = [r for r in rows if r[0].startswith(f"2025-06-{day:02d}")]
        assert sums[f"2025-06-{day:02d}"] == (sum(n for _, n, k in own if k == "debit"), sum(n for _, n, k in own if k == "credit"), len(own))
    assert tuple(D.counts(spark, root).first()) == (60, 0)
    assert {r.day for r in D.days(spark, root, "2 days").collect()} == {f"2025-06-{d:02d}" for d in range(1, 7)}


def test_index_reads_its_documents_once(spark, root):
    read = spark.sparkContext.accumulator(0)

    def mail(k):
        read.add(1)
        return (f"m{k}", "Debit alert", "" if k % 4 else "Rs 5 debited", None)

    docs = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(mail), "id string, subject string, body_text string, bank_name string")
    docs = docs.unionByName(spark.createDataFrame([("none", "", None, "-")], docs.schema))
    index = SearchIndex(spark, root)
    with Commit(spark, root, "b1") as c:
        index.add(c, docs)
    assert read.value == 40
    assert sorted(r.doc_len for r in index.lengths().collect()) == [0] + 30 * [2] + 10 * [5]
    assert index.postings().filter("token = ''").isEmpty() and index.postings().count() == 110
    assert sorted(index.lengths().collect()) == sorted(Q.doc_lengths(docs).collect())
