"""The review from files to findings, its states, deletion, and files that arrive later."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import purge
from sheetlens.operators.listing import csv_files
from sheetlens.operators.store import ReviewStore, latest
from sheetlens.plans import review
from sheetlens.schema import Settings, migrate
from sheetlens.sources.csv_sink import write_csv_files
from sheetlens.sources.files import delete_file, file_contents, file_exists, pdf_files, pending_documents
from sheetlens.streaming.arrivals import watch

NOW = "2024-01-05 15:07:00"


def reader(image: bytes) -> str:
    if image == b"blot":
        raise ValueError("unreadable")
    return image.decode() + " "


def inspector(prompt: str, image: bytes, max_tokens: int) -> str:
    image = base64.b64decode(image)
    assert max_tokens == 2048
    if b"down" in image:
        raise ConnectionError("model is down")
    found = [{"issue_type": "Missing Tag", "severity": "HIGH", "description": f"{image.decode()}, \"here\"", "location_hint": None}]
    return "```json\n" + json.dumps({"issues": found if b"tag" in image else []}) + "\n```"


def folder(tmp_path, **files):
    d = tmp_path / "in"
    d.mkdir()
    for name, content in files.items():
        (d / name.replace("_dot_", ".")).write_bytes(content)
    return str(d)


def test_review(spark, tmp_path):
    d = folder(tmp_path, a_dot_pdf=b"\f".join([b"tag %d" % i for i in range(12)]), b_dot_PDF=b"tag 1\fdown\ftag 3", c_dot_txt=b"x", e_dot_pdf=b"blot")
    store = ReviewStore(spark, str(tmp_path / "store"))
    review.ingest(spark, store, d, NOW)
    assert {r.filename: r.status for r in store.documents().collect()} == {"a.pdf": "pending", "b.PDF": "pending", "e.pdf": "pending"}
    work = str(tmp_path / "work")
    rows = {r.filename: r for r in review.analyse(spark, store, work, 1, NOW, file_contents(spark, d), reader, inspector).collect()}
    assert (rows["a.pdf"].status, rows["a.pdf"].page_count) == ("completed", 10)
    assert rows["a.pdf"].analyzed_at is not None
    assert (rows["b.PDF"].status, rows["b.PDF"].analyzed_at) == ("failed", None)
    assert rows["e.pdf"].status == "completed"
    issues = store.issues().join(store.documents().select(F.col("id").alias("document_id"), "filename"), "document_id")
    assert {r["filename"]: r["count"] for r in issues.groupBy("filename").count().collect()} == {"a.pdf": 10, "b.PDF": 1}
    assert {r.raw_ocr_text for r in issues.where("filename = 'b.PDF'").collect()} == {"tag 1"}
    # a second run appends
    contents = file_contents(spark, d)
    review.analyse(spark, store, work, 2, NOW, contents, reader, inspector)
    assert store.issues().count() == 22
    assert store.issues().select("id").distinct().count() == 22
    # a run of one document leaves the others
    only = store.documents().where("filename = 'b.PDF'").select("id")
    review.analyse(spark, store, work, 3, NOW, contents, reader, inspector, ids=only, settings=Settings(max_pages=1))
    rows = {r.filename: (r.status, r.page_count) for r in store.documents().collect()}
    assert rows == {"a.pdf": ("completed", 10), "b.PDF": ("completed", 1), "e.pdf": ("completed", 1)}
    assert store.issues().count() == 23
    # deletion hides the document and its issues
    review.delete(store, store.documents().where("filename = 'a.pdf'").select("id"), 100)
    assert store.documents().count() == 2
    assert store.issues().count() == 3


def splitter(content: bytes, limit: int) -> list[bytes]:
    if content.startswith(b"corrupt"):
        raise ValueError("no PDF")
    return [] if content == b"none" else content.split(b"\f")[:limit]


def test_one_bad_file_fails_alone(spark, tmp_path):
    d = folder(tmp_path, a_dot_pdf=b"tag 1\ftag 2", b_dot_pdf=b"corrupt", c_dot_pdf=b"none", d_dot_pdf=b"tag\fdown")
    store = ReviewStore(spark, str(tmp_path / "store"))
    review.ingest(spark, store, d, NOW)
    contents = file_contents(spark, d)
    os.remove(d + "/a.pdf")  # gone before its content is read
    review.analyse(spark, store, str(tmp_path / "w1"), 1, NOW, contents, reader, inspector, splitter)
    rows = {r.filename: (r.status, r.page_count, r.analyzed_at is not None) for r in store.documents().collect()}
    assert rows == {"a.pdf": ("failed", None, False), "b.pdf": ("failed", None, False), "c.pdf": ("completed", 0, True), "d.pdf": ("failed", 2, False)}
    assert {r.filename: r.error for r in store.failures().collect()} == {"a.pdf": "FileNotFoundError: the file is gone", "b.pdf": "ValueError: no PDF", "d.pdf": "ConnectionError: model is down"}
    assert store.issues().count() == 1
    # the page count stands in the log before the model is asked
    log = [(r.seq, r.status, r.page_count) for r in store.log().where("filename = 'd.pdf'").orderBy("seq").collect()]
    assert log == [(0, "pending", None), (11, "processing", None), (12, "processing", 2), (13, "failed", 2)]
    # a mended file runs again, and only failed pages are asked again
    (tmp_path / "in" / "b.pdf").write_bytes(b"tag mended")
    again = store.failures().select("id")
    review.analyse(spark, store, str(tmp_path / "w2"), 2, NOW, file_contents(spark, d), reader, inspector, splitter, ids=again)
    rows = {r.filename: r.status for r in store.documents().collect()}
    assert rows["b.pdf"] == "completed" and rows["a.pdf"] == "failed"
    assert sorted((r.run_id, r.error is None) for r in store.replies().collect()) == [(1, False), (1, True), (2, False), (2, True)]


def test_a_dead_run_gives_its_documents_back(spark, tmp_path):
    d = folder(tmp_path, a_dot_pdf=b"tag 1", b_dot_pdf=b"tag 2")
    store = ReviewStore(spark, str(tmp_path / "store"))
    review.ingest(spark, store, d, NOW)

    def dies(prompt, image, max_tokens):
        os._exit(1)  # takes the Python worker, and so the job, with it

    contents = file_contents(spark, d)
    with pytest.raises(Exception):
        review.analyse(spark, store, str(tmp_path / "w1"), 1, NOW, contents, reader, dies)
    assert {r.status for r in store.documents().collect()} == {"processing"}
    # while the claim lives, another run finds nothing to do; an hour later it takes over
    review.analyse(spark, store, str(tmp_path / "w2"), 2, "2024-01-05 15:30:00", contents, reader, inspector)
    assert {r.status for r in store.documents().collect()} == {"processing"}
    assert store.issues().count() == 0
    review.analyse(spark, store, str(tmp_path / "w3"), 3, "2024-01-05 16:30:00", contents, reader, inspector)
    assert {r.status for r in store.documents().collect()} == {"completed"}
    assert store.issues().count() == 2


def test_overlapping_runs_share_documents(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = lambda rows: sorted(r.id for r in rows.collect())
    assert got(store.claim(docs("a", "b"), 1, "2024-01-01 10:00:00", "2024-01-01 11:00:00")) == ["a", "b"]
    assert got(store.claim(docs("a", "b", "c"), 2, "2024-01-01 10:30:00", "2024-01-01 11:30:00")) == ["c"]
    assert got(store.claim(docs("a"), 1, "2024-01-01 10:40:00", "2024-01-01 12:00:00")) == ["a", "b"]  # holds on
    # both wrote their claims before either looked: one wins each
    at = ("2024-01-01 10:45:00", "2024-01-01 12:30:00")
    for run in (4, 3):
        claims = docs("d").withColumns({"run_id": F.lit(run).cast("long"), "claimed_at": F.lit(at[0]).cast("timestamp_ntz"), "expires_at": F.lit(at[1]).cast("timestamp_ntz"), "released": F.lit(False)})
        claims.write.mode("append").parquet(store.claims_path)
    assert got(store.held(3, at[0])) == ["d"] and got(store.held(4, at[0])) == []
    assert got(store.held(1, "2024-01-01 11:30:00")) == ["a"]  # b has lapsed
    store.release(3)
    assert got(store.held(4, at[0])) == ["d"]
    assert got(store.held(3, at[0])) == []


def test_the_model_is_asked_once(spark, tmp_path):
    """The same page in many files is one question; later runs ask what has no answer."""
    pages = {f"{x}_dot_pdf": b"tag same\fdown" for x in "abc"}
    d = folder(tmp_path, **pages)
    store = ReviewStore(spark, str(tmp_path / "store"))
    review.ingest(spark, store, d, NOW)
    for run in (1, 2):
        review.analyse(spark, store, str(tmp_path / "w"), run, NOW, file_contents(spark, d), reader, inspector)
    rows = [(r.run_id, r.error) for r in store.replies().orderBy("run_id", "error").collect()]
    assert rows == [(1, None), (1, "ConnectionError: model is down"), (2, "ConnectionError: model is down")]
    assert store.issues().count() == 6


def data_files(path):
    return {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}


def purgeable(spark, tmp_path):
    """Six documents with a file each, their findings in one data file for each two."""
    d = folder(tmp_path, **{f"f{i}_dot_pdf": b"tag %d" % i for i in range(6)})
    store = ReviewStore(spark, str(tmp_path / "store"))
    for pair in (0, 2, 4):
        review.add(store, pending_documents(pdf_files(spark, d).where(F.col("filename").isin(f"f{pair}.pdf", f"f{pair + 1}.pdf")).coalesce(1), NOW))
        ids = store.documents().where("status = 'pending'").select("id")
        review.analyse(spark, store, str(tmp_path / "w"), pair + 1, NOW, file_contents(spark, d), reader, inspector, ids=ids)
    return d, store


def test_purge(spark, tmp_path):
    d, store = purgeable(spark, tmp_path)
    some = store.documents().where("filename IN ('f0.pdf', 'f2.pdf')").select("id")
    gone = {r.id for r in some.collect()}
    review.delete(store, some, 100)
    views = lambda: (sorted(map(str, store.documents().collect())), sorted(map(str, store.issues().collect())))
    before, files = views(), data_files(store.issues_path)
    assert {r.found for r in review.purge(store).collect()} == {True}
    assert sorted(os.listdir(d)) == ["f1.pdf", "f3.pdf", "f4.pdf", "f5.pdf"]
    assert views() == before
    for path, key in ((store.log_path, "id"), (store.issues_path, "document_id"), (store.claims_path, "id")):
        assert not gone & {r[0] for r in spark.read.parquet(path).select(key).collect()}
    after = data_files(store.issues_path)
    held = {f for f in files if f in after}
    assert 0 < len(held) < len(files) and all(after[f] == files[f] for f in held)
    # nothing left to do changes no file; a file that is already gone is no error
    state = data_files(store.issues_path)
    assert review.purge(store).count() == 0 and data_files(store.issues_path) == state
    os.remove(d + "/f5.pdf")
    review.delete(store, store.documents().where("filename = 'f5.pdf'").select("id"), 101)
    assert [r.found for r in review.purge(store).collect()] == [False]
    assert store.documents().count() == 3


def test_a_purge_that_died_is_finished(spark, tmp_path, monkeypatch):
    d, store = purgeable(spark, tmp_path)
    review.delete(store, store.documents().where("filename = 'f0.pdf'").select("id"), 100)
    want = sorted(r.id for r in store.issues().collect())
    plain, calls = purge.moved, []

    def dies(steps):
        calls.append(1)
        if len(calls) == 2:  # old files are gone, new ones have not moved in
            raise KeyboardInterrupt
        return plain(steps)

    gone = store.spark.createDataFrame([(r.id,) for r in store.log().where("deleted").select("id").collect()], "id string")
    monkeypatch.setattr(purge, "moved", dies)
    with pytest.raises(KeyboardInterrupt):
        purge.without_keys(spark, store.issues_path, "document_id", gone)
    monkeypatch.setattr(purge, "moved", plain)
    review.purge(store)
    assert sorted(r.id for r in spark.read.parquet(store.issues_path).collect()) == want
    assert not [f for f in os.listdir(store.issues_path) if f.startswith(("_new", "_swap"))]


def test_checks_when_written(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    row = ("i", "a.pdf", "/a.pdf", None, "pending", 0, False)
    rows = lambda **other: spark.createDataFrame([row], "id string, filename string, file_path string, page_count int, status string, seq long, deleted boolean").withColumns({"uploaded_at": F.lit(NOW).cast("timestamp_ntz"), **{k: F.lit(v) for k, v in other.items()}})
    store.append_states(rows())
    for other in ({"status": "unheard"}, {"filename": "x" * 256}, {"file_path": None}):
        with pytest.raises(Exception, match="breaks its checks"):
            store.append_states(rows(**other))
    assert [r.id for r in store.documents().collect()] == ["i"]


def test_migrations(spark):
    name = "review_migrations"
    tables = lambda: {r.tableName for r in spark.sql(f"SHOW TABLES IN {name}").collect()} - {"schema_version"}
    assert migrate(spark, name, to=1) == [(1, True)]
    assert tables() == {"documents", "issues", "pages"}
    spark.sql(f"INSERT INTO {name}.pages VALUES ('d', 1, NULL, 'text')")
    assert migrate(spark, name) == [(2, True)] and migrate(spark, name) == []
    assert {"claims", "replies"} < tables()
    assert migrate(spark, name, to=0) == [(2, False), (1, False)]
    assert all(t.endswith("_kept") for t in tables())
    assert migrate(spark, name, to=1) == [(1, True)]
    assert [r.ocr_text for r in spark.table(f"{name}.pages").collect()] == ["text"]
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_newest_of_equally_new(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "p"), ("a", 2, "q"), ("b", 1, None)], "id string, seq long, state string")
    assert sorted((r.id, r.state) for r in latest(log, "id", "seq").collect()) == [("a", "q"), ("b", None)]


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "i1", "missing_tag", "low", 'a "b"\nc', None)], "document_id string, page_number int, id string, issue_type string, severity string, description string, location_hint string")
    want = 'id,page_number,issue_type,severity,description,location_hint\ni1,1,missing_tag,low,"a ""b""\nc",""'
    assert csv_files(rows).first().csv == want
    docs = spark.createDataFrame([("d", "x/Plan.PDF"), ("e", "none.pdf")], "id string, filename string")
    for _ in range(2):  # a second export takes the place of the first
        write_csv_files(rows, docs, f"file://{tmp_path}/csv")
        found = {os.path.relpath(os.path.join(d, f), tmp_path / "csv"): open(os.path.join(d, f), newline="").read() for d, _, names in os.walk(tmp_path / "csv") for f in names}
        assert found == {"82/d/Plan_issues.csv": want}


def test_csv_files_of_a_failed_export_stay_hidden(spark, tmp_path):
    from sheetlens.sources import csv_sink as C

    spark.dataSource.register(C.NamedFiles)
    rows = spark.range(100).selectExpr("'ab' AS shard", "cast(id AS string) AS document_id", "'x.csv' AS name", "if(id = 70, raise_error('down'), 'text') AS csv")
    with pytest.raises(Exception, match="down"):
        rows.write.format(C.FORMAT).mode("append").option("path", f"file://{tmp_path}/csv").save()
    assert [d for d in os.listdir(tmp_path / "csv") if not d.startswith("_")] == []  # what tasks had staged is hidden, and goes with the abort


def test_files(spark, tmp_path):
    d = folder(tmp_path, a_dot_pdf=b"12345", b_dot_pdf=b"1" * 20, c_dot_doc=b"")
    assert [r.filename for r in pdf_files(spark, d, limit=5).collect()] == ["a.pdf"]
    assert file_exists(spark, d + "/a.pdf")
    assert delete_file(spark, d + "/a.pdf")
    assert not delete_file(spark, d + "/a.pdf")


def test_arrivals(spark, tmp_path):
    d = folder(tmp_path, a_dot_pdf=b"x")
    store = ReviewStore(spark, str(tmp_path / "store"))
    watch(spark, store, d, str(tmp_path / "check"), NOW).awaitTermination(60)
    (tmp_path / "in" / "b.pdf").write_bytes(b"y")
    (tmp_path / "in" / "large.pdf").write_bytes(b"y" * 30)
    watch(spark, store, d, str(tmp_path / "check"), NOW, limit=20).awaitTermination(60)
    assert sorted(r.filename for r in store.documents().collect()) == ["a.pdf", "b.pdf"]


def test_packed_csv_files_take_little_disk(spark, tmp_path, monkeypatch):
    """Archives hold what single files hold, under the same names, in few blocks; one that is full is followed by the next."""
    from sheetlens.sources import csv_sink as C

    rows = spark.range(1200).selectExpr("cast(id % 400 AS string) AS document_id", "cast(id AS int) AS page_number", "concat('i', id) AS id", "'missing_tag' AS issue_type", "'low' AS severity", "'a \"b\"' AS description", "cast(null AS string) AS location_hint")
    docs = spark.range(401).selectExpr("cast(id AS string) AS id", "concat('x/Plan', id, '.PDF') AS filename")
    write_csv_files(rows, docs, f"file://{tmp_path}/plain")
    plain = {os.path.relpath(os.path.join(d, f), tmp_path / "plain"): open(os.path.join(d, f), newline="").read() for d, _, names in os.walk(tmp_path / "plain") for f in names}
    for _ in range(2):  # a second export takes the place of the first
        write_csv_files(rows, docs, f"file://{tmp_path}/packed", packed=True)
        assert {r.file: r.csv for r in C.packed_csv_files(spark, f"file://{tmp_path}/packed").collect()} == plain
    assert len(plain) == 400
    blocks = lambda at: sum(os.lstat(os.path.join(d, f)).st_blocks for d, folders, names in os.walk(at) for f in [*folders, *names])
    assert blocks(tmp_path / "packed") < 0.7 * blocks(tmp_path / "plain")

    class Disk:
        create_dir = staticmethod(lambda path: os.makedirs(path, exist_ok=True))
        open_output_stream = staticmethod(lambda path, compression: open(path, "wb"))

    monkeypatch.setattr(C, "ARCHIVE_BYTES", 10)
    archives = C.Archives(Disk, str(tmp_path / "own"))
    for shard, name in (("aa", "1/x.csv"), ("aa", "2/x.csv"), ("aa", "3/x.csv"), ("ab", "4/x.csv")):
        archives.add(shard, name, b"123456")
    archives.close()
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "own") for d, _, names in os.walk(tmp_path / "own") for f in names) == ["aa/00000.tar.gz", "aa/00001.tar.gz", "ab/00002.tar.gz"]


def test_texts_move_only_where_pages_are_dealt(spark, tmp_path, monkeypatch):
    """Between large tables: questions and stored texts come from the buckets that pages are dealt to once, and only places and replies are moved to them."""
    d = folder(tmp_path, a_dot_pdf=b"tag 1\ftag 2", b_dot_pdf=b"tag 1\ftag 2")
    store, plans = ReviewStore(spark, str(tmp_path / "store")), []
    review.ingest(spark, store, d, NOW)
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    inspect, append = review.P.inspect, store.append_issues
    monkeypatch.setattr(review.P, "inspect", lambda questions, *more: inspect(seen(questions), *more))
    monkeypatch.setattr(store, "append_issues", lambda rows, **more: append(seen(rows), **more))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        review.analyse(spark, store, str(tmp_path / "w"), 1, NOW, file_contents(spark, d), reader, inspector)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.issues().count() == 4 and store.replies().count() == 2
    assert [plan.count("Bucketed: true") for plan in plans] == [1, 1] and not any("Window" in plan for plan in plans)
    assert {r.total_pages for r in spark.read.parquet(str(tmp_path / "w" / "run=1" / "pages")).collect()} == {2}
