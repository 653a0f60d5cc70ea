"""Jobs as a stream, uploads, results, and the error paths of the review."""

import datetime
import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lacre.operators import layout, review
from lacre.plans import recipes
from lacre.plans.queries import QUERIES
from lacre.sources import documents, job_results, word_tables
from lacre.streaming import expiry, intake, jobs


def at(minute):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)


@pytest.mark.parametrize("key", ["bigint", "string"])
def test_the_stream_keeps_a_tombstone(spark, tmp_path, key):
    a, b, c = (1, 2, 3) if key == "bigint" else ("0" * 31 + "a", "0" * 31 + "b", "0" * 31 + "c")
    schema = f"id {key}, ts timestamp, seq bigint, event string"
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    batches = [
        [(a, at(0), 1, "created"), (b, at(0), 2, "created"), (b, at(1), 3, "started")],
        [(a, at(2), 4, "deleted"), (b, at(2), 5, "done")],
        [(a, at(3), 6, "started"), (b, at(1), 1, "extracted")],
        [(c, at(90), 7, "created")],
        [(c, at(91), 8, "started")],
    ]
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "0 seconds")
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = jobs.follow(events).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("update")
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    states = {x: [s[1] for s in seen if s[0] == x] for x in (a, b, c)}
    assert states[a] == ["recebido", "apagado"]
    assert states[b][:2] == ["processando", "pronto"] and states[b][-1] == "expirado" and set(states[b]) == {"processando", "pronto", "expirado"}
    assert states[c] == ["recebido", "processando"]
    assert next(s for s in seen if s[0] == b and s[1] == "pronto")[2:] == (1.0, at(30))


def test_batch_states(spark):
    rows = [("a", at(0), 1, "created"), ("a", at(1), 2, "failed"), ("b", at(0), 3, "created"), ("b", at(1), 4, "deleted"), ("b", at(2), 5, "started"), ("c", at(5), 6, "extracted")]
    found = {r.id: (r.status, r.progresso, r.expira_em) for r in jobs.states(spark.createDataFrame(rows, "id string, ts timestamp, seq bigint, event string")).collect()}
    assert found == {"a": ("erro", None, at(30)), "c": ("processando", 0.5, at(35))}
    kept = jobs.expired(spark.createDataFrame([("f" * 32, at(0)), ("../x", at(0)), ("e" * 32, at(9))], "id string, expira_em timestamp"), F.lit(at(5)))
    assert [r.id for r in kept.collect()] == ["f" * 32]


def test_results_are_a_document_a_job(spark, tmp_path):
    pages = spark.createDataFrame([("a", 2, 1.0, 2.0, None), ("a", 1, 1.0, 2.0, [("CPF",)]), ("b", 1, 1.0, 2.0, None)], "id string, numero int, largura double, altura double, entidades array<struct<type: string>>")
    state = spark.createDataFrame([("a", "pronto"), ("b", "erro")], "id string, status string")
    folder = str(tmp_path / "out")
    jobs.write_results(jobs.results(pages, state), folder)
    (row,) = job_results.stored(spark, folder).collect()
    assert row["id"] == "a" and [p["numero"] for p in json.loads(row["resultado"])["paginas"]] == [1, 2]
    assert [p.name for p in (tmp_path / "out").rglob("*.json")] == ["a.json"]


def documents_in(spark, folder):
    return {r["id"]: r["resultado"] for r in job_results.stored(spark, folder).collect()}


def test_runs_leave_each_other_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, resultado string").repartition(3)
    jobs.write_results(rows(("a", "1"), ("b", "1"), ("c", "ção")), folder)
    jobs.write_results(rows(("b", "2"), ("d", "2")), folder)
    assert documents_in(spark, folder) == {"a": "1", "b": "2", "c": "ção", "d": "2"}
    jobs.write_results(rows().limit(0), folder)
    assert len(documents_in(spark, folder)) == 4 and not list((tmp_path / "out" / ".staging").iterdir())
    with pytest.raises(Exception, match="only appends"):
        rows(("a", "9")).write.format("job_results").mode("overwrite").save(folder)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    jobs.write_results(spark.createDataFrame([("a", "1")], "id string, resultado string"), folder)
    broken = spark.createDataFrame([("x", "1"), ("y", "1"), ("../z", "1"), ("w", "1")], "id string, resultado string").repartition(4)
    with pytest.raises(Exception, match="no id of a job"):
        jobs.write_results(broken, folder)
    assert documents_in(spark, folder) == {"a": "1"}
    assert sorted(p.name for p in tmp_path.rglob("*.json")) == ["a.json"] and not list((tmp_path / "out" / ".staging").iterdir())


def test_attempts_that_did_not_count_are_left_out(tmp_path):
    writer = job_results.JobResultsWriter(str(tmp_path))
    for name in ("000000-1", "000000-2", "000001-3"):
        (tmp_path / ".staging" / writer.run / name).mkdir(parents=True)
        (tmp_path / ".staging" / writer.run / name / f"{name}.json").write_text("{}")
    writer.commit([job_results.Attempt("000000-2", 1), job_results.Attempt("000001-3", 1), None])
    assert sorted(p.name for p in tmp_path.rglob("*.json")) == ["000000-2.json", "000001-3.json"]


def test_purge_gives_a_row_for_each_outcome(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    jobs.write_results(spark.createDataFrame([(x, x) for x in "abc"], "id string, resultado string"), folder)
    held = spark.createDataFrame([(r["id"], r["path"]) for r in job_results.listed(spark, folder).collect()], "id string, path string")
    stuck = spark.createDataFrame([("stuck", f"nosuchfs://{tmp_path}/x"), ("gone", f"{tmp_path}/gone.json")], "id string, path string")
    doomed = held.where("id <> 'b'").unionByName(stuck)
    found = {r["id"]: (r["removed"], r["erro"]) for r in job_results.purge(doomed).collect()}
    assert {x: ok for x, (ok, _) in found.items()} == {"a": True, "c": True, "gone": True, "stuck": False}
    assert found["a"][1] is None and "nosuchfs" in found["stuck"][1]
    assert documents_in(spark, folder) == {"b": "b"}
    again = job_results.purge(doomed.where("id <> 'stuck'")).collect()
    assert all(r["removed"] for r in again)


def test_a_deletion_is_tried_again(tmp_path, monkeypatch):
    tries = []

    def opened(path):
        tries.append(path)
        if len(tries) < 3:
            raise OSError("busy")
        return word_tables.opened(path)

    monkeypatch.setattr(job_results, "PAUSE", 0.0)
    monkeypatch.setattr(job_results, "opened", opened)
    (tmp_path / "x").write_text("1")
    assert job_results.failure(str(tmp_path / "x")) is None and len(tries) == 3 and not (tmp_path / "x").exists()
    monkeypatch.setattr(job_results, "opened", lambda path: 1 / 0 if not path else (_ for _ in ()).throw(OSError("busy")))
    assert job_results.failure("x") == "OSError: busy"


def test_each_upload_is_taken_once(spark, tmp_path):
    """Over two runs of the stream, and where a batch is run again after its folder was written."""
    source, out, state = tmp_path / "in", str(tmp_path / "jobs"), tmp_path / "state"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"%PDF-1.7 a")
    (source / "b.pdf").write_bytes(b"no pdf")
    (source / "c.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    intake.take_in(spark, str(source), out, str(state), most_bytes=50).awaitTermination()
    (source / "d.pdf").write_bytes(b"%PDF-1.7 d")
    intake.take_in(spark, str(source), out, str(state), most_bytes=50).awaitTermination()
    # The second batch has been stored but not noted as done: a driver that dies between the two.
    for name in (".1.crc", "1"):
        (state / "commits" / name).unlink(missing_ok=True)
    intake.take_in(spark, str(source), out, str(state), most_bytes=50).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["event"], r["recusa"]) for r in rows} == {"a.pdf": ("created", None), "b.pdf": (None, 415), "c.pdf": (None, 413), "d.pdf": ("created", None)}
    assert len(rows) == 4 == len({r["id"] for r in rows}) and all(len(r["id"]) == 32 for r in rows)
    states = jobs.states(spark.read.parquet(out).where("event IS NOT NULL"))
    assert {r["status"] for r in states.collect()} == {"recebido"}


def followed(spark, tmp_path, batches):
    """What the timers' stream gives for batches of events, one file each."""
    schema = "id string, ts timestamp, seq bigint, event string"
    source, seen = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = expiry.lives(events.withWatermark("ts", "10 minutes")).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("update")
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_a_renewed_deadline_does_not_expire(spark, tmp_path):
    """a is renewed before its time is over, b is not, c is deleted and stays so, d comes late and early."""
    seen = followed(spark, tmp_path, [
        [("a", at(0), 1, "created"), ("b", at(0), 2, "created"), ("c", at(0), 3, "created"), ("d", at(10), 4, "started")],
        [("a", at(20), 5, "renewed"), ("c", at(1), 6, "deleted"), ("d", at(5), 7, "created")],
        [("c", at(13), 8, "started"), ("z", at(46), 9, "created")],
        [("z", at(47), 10, "started")],
        [("z", at(61), 11, "done")],
        [("z", at(62), 12, "done")],
    ])
    states = {x: [s[1] for s in seen if s[0] == x] for x in "abcdz"}
    assert states["a"] == ["recebido", "recebido", "expirado"] and states["b"] == ["recebido", "expirado"]
    assert [s[3] for s in seen if s[0] == "a"] == [at(30), at(50), at(50)]
    assert states["c"] == ["recebido", "apagado"]
    assert states["d"] == ["processando", "processando", "expirado"] and [s[3] for s in seen if s[0] == "d"] == [at(40), at(35), at(35)]
    order = [s[0] for s in seen if s[1] == "expirado"]
    assert set(order[:2]) == {"b", "d"} and order[2:] == ["a"]


class Spy:
    """State and timers of one job that note each call."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, set()

    def getValueState(self, *_):
        return self

    def called(self, name, value=None):
        self.calls.append(name)
        return value

    exists = lambda self: self.called("exists", self.held is not None)
    get = lambda self: self.called("get", self.held)
    update = lambda self, value: self.called("update", setattr(self, "held", value))
    clear = lambda self: self.called("clear", setattr(self, "held", None))
    listTimers = lambda self: self.called("listTimers", iter(self.timers))
    registerTimer = lambda self, at: self.called("registerTimer", self.timers.add(at))
    getCurrentWatermarkInMs = lambda self: 0
    getExpiryTimeInMs = lambda self: 0


def test_a_job_asks_for_its_state_once():
    """Each call to the state is a message: with many jobs they are what takes the time."""
    spy, life = Spy(), expiry.JobLife(datetime.timedelta(minutes=30), False)
    life.init(spy)
    minute = 60_000_000
    take = lambda *rows: [tuple(r) for r in life.handleInputRows(("a",), (Row(id="a", ts=t and t * minute, seq=n, event=e) for t, n, e in rows), spy)]
    until = lambda m: datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)
    assert take((None, 0, "started")) == [] and spy.calls == ["get"]
    spy.calls.clear()
    assert take((12, 3, "started"), (10, 1, "created"), (12, 2, "failed")) == [("a", "processando", 0.0, until(40))]
    assert spy.calls == ["get", "update", "registerTimer"] and spy.timers == {40 * 60_000}
    spy.calls.clear()
    assert take((13, 4, "done"), (11, 9, "failed")) == [("a", "pronto", 1.0, until(40))]
    assert spy.calls == ["get", "update"]
    assert take((20, 5, "renewed")) == [("a", "pronto", 1.0, until(50))] and spy.timers == {40 * 60_000, 50 * 60_000}
    assert take((None, 6, "deleted")) == [("a", "apagado", None, until(50))] and take((21, 7, "started")) == []
    spy.calls.clear()
    assert list(life.handleExpiredTimer(("a",), spy, spy)) == [] and spy.calls[0] == "get" and spy.held is not None
    spy.getExpiryTimeInMs = lambda: 50 * 60_000
    assert list(life.handleExpiredTimer(("a",), spy, spy)) == [] and spy.held is None


def test_timers_go_off_by_the_clock(spark, tmp_path):
    """Without any further event. The stream is stopped here, as one with timers by the clock has no end of its own."""
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    rows = [("a", now - datetime.timedelta(hours=1), 1, "created"), ("b", now + datetime.timedelta(hours=1), 2, "created")]
    schema, source, seen = "id string, ts timestamp, seq bigint, event string", str(tmp_path / "in"), []
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    out = expiry.lives(spark.readStream.schema(schema).parquet(source), by_clock=True).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("update")
    query = out.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    until = time.monotonic() + 60
    while time.monotonic() < until and query.isActive and ("a", "expirado") not in {s[:2] for s in seen}:
        time.sleep(0.5)
    query.stop()
    assert {x: [s[1] for s in seen if s[0] == x] for x in "ab"} == {"a": ["recebido", "expirado"], "b": ["recebido"]}


def test_a_page_without_a_size_is_an_error(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, page int")
    sizes = spark.createDataFrame([(1, 0, 5.0)], "doc_id int, page int, largura double")
    entities = spark.createDataFrame([], "doc_id int, page int, ord int, type string, start int, end int, confidence double, requires_review boolean")
    assert review.pages_of(pages.where("page = 0"), sizes, entities).first()["largura"] == 5.0
    with pytest.raises(Exception, match="no size for page 1 of 1"):
        review.pages_of(pages, sizes, entities).collect()


def test_pages_are_joined_in_tasks_of_bounded_size(spark, monkeypatch):
    """Tasks follow the number of rows, not their compressed bytes, and joins and groups need no second shuffle."""
    monkeypatch.setattr(recipes, "TASK_ROWS", 300, raising=False)
    found = QUERIES["pages_with_entities"](spark, "/root/testdata/sf0.001")
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(rows) > 10 and max(rows) < 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 == plan.count("REPARTITION_BY_NUM")


def test_ids_of_null_keys_do_not_meet(spark):
    rows = spark.createDataFrame([(None, "a", 0, "CPF"), ("a", None, 0, "CPF"), ("a|0", None, 0, "CPF"), ("a", "0", 0, "CPF")], "k string, l string, ord int, type string")
    assert len({r["entidade_id"] for r in review.entity_ids(rows, ("k", "l")).collect()}) == 4


def test_a_second_detection_that_differs_is_an_error(spark):
    rows = spark.createDataFrame([(1, 0, "CPF"), (1, 1, "EMAIL")], "doc_id int, ord int, type string")
    held = review.entity_ids(rows).select("doc_id", "ord", "type", "entidade_id")
    assert review.recovered(held, rows, ("doc_id",)).count() == 2
    for fresh in (rows.where("ord = 0"), rows.withColumn("type", F.lit("CPF")), rows.unionByName(spark.createDataFrame([(1, 2, "CPF")], rows.schema))):
        with pytest.raises(Exception, match="detection differs"):
            review.recovered(held, fresh, ("doc_id",)).collect()


def test_uploads_and_text_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    found = {r.path.rsplit("/", 1)[1]: r.recusa for r in documents.uploads(spark, str(tmp_path), 50).collect()}
    assert found == {"a.pdf": None, "b.pdf": 415, "c.pdf": 413}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_bytes("um\r\ndois".encode())
    assert documents.text_files(spark, str(tmp_path / "t")).first().text == "um\r\ndois"

    def parser(content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("no PDF")
        return [{"page": 0, "text": content.decode()}]

    rows = {r.doc_id.rsplit("/", 1)[1]: (r.erro, r.text) for r in documents.parsed(spark.read.format("binaryFile").load(str(tmp_path / "*.pdf")), parser, "page int, text string").collect()}
    assert rows["a.pdf"] == (None, "%PDF-1.7 x") and rows["b.pdf"] == ("ValueError: no PDF", None)


def test_errors_of_a_review(spark):
    known = spark.createDataFrame([("a", 1, "CPF", 0)], "entidade_id string, pagina int, type string, ord int")
    schema = "entidade_id string, pagina int, acao string, bboxes array<struct<x0: double, y0: double, x1: double, y1: double>>"
    box = [(0.0, 0.0, 1.0, 1.0)]
    with pytest.raises(Exception, match="another page"):
        review.known_decisions(known, spark.createDataFrame([("a", 2, "tarjar", None)], schema)).collect()
    for row, text in ((("m", 1, "publicar", []), "no rectangle"), (("m", 7, "tarjar", box), "no such page")):
        with pytest.raises(Exception, match=text):
            review.manual_decisions(known, spark.createDataFrame([row], schema), known.select("pagina")).collect()
    other = known.withColumn("type", F.lit("RG"))
    for fresh in (other, known.limit(0)):
        with pytest.raises(Exception, match="differs"):
            review.recovered(known, fresh, ("pagina",)).collect()


def test_a_span_beyond_its_page_is_an_error(spark):
    glyphs = spark.createDataFrame([(1, 0, i, c, float(i), 0.0, i + 1.0, 1.0) for i, c in enumerate("abc")], "doc_id int, page int, idx int, char string, x0 double, y0 double, x1 double, y1 double")
    schema = "doc_id int, page int, span_id int, type string, start int, end int, por_ocr boolean"
    (row,) = layout.entity_rectangles(layout.pages_of_characters(glyphs), spark.createDataFrame([(1, 0, 0, "EMAIL", 1, 3, False)], schema)).collect()
    assert (row.x0, row.x1) == (1.0, 3.0)
    with pytest.raises(Exception, match="beyond its page"):
        layout.entity_rectangles(layout.pages_of_characters(glyphs), spark.createDataFrame([(1, 0, 0, "EMAIL", 1, 4, False)], schema)).collect()


def test_rectangles_of_entities_keep_their_columns_without_a_broadcast(spark):
    """A small file may become many rows, which the driver must not hold; the entity's type comes with its rectangles."""
    found = QUERIES["entity_rectangles"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    glyphs = spark.createDataFrame([(1, 0, i, c, float(i), 0.0, i + 1.0, 1.0) for i, c in enumerate("abc")], "doc_id int, page int, idx int, char string, x0 double, y0 double, x1 double, y1 double")
    entities = spark.createDataFrame([(1, 0, 7, "EMAIL", 1, 3, False)], "doc_id int, page int, span_id int, type string, start int, end int, por_ocr boolean")
    (row,) = layout.entity_rectangles(layout.pages_of_characters(glyphs), entities, ("span_id", "type")).collect()
    assert (row.span_id, row.type, row.x0, row.x1) == (7, "EMAIL", 1.0, 3.0)
