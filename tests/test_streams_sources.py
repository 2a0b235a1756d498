"""Streams, sources, sinks, the engine facade."""

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.engine import Engine, OverBudget, Router
from chronoloom.operators import ingest as I
from chronoloom.sources import readers
from chronoloom.streaming import live
from chronoloom.tables import load


def test_stream_equals_batch(spark, sf):
    events = load(spark, sf, "events")
    streamed = {tuple(r) for r in live.run(live.tumbling(live.read_events(spark, sf))).select("event_type", "start_s", "n").collect()}
    whole = {tuple(r) for r in live.tumbling(events).select("event_type", "start_s", "n").collect()}
    assert streamed <= whole and len(streamed) > 0.8 * len(whole)  # the last window stays open


def test_state_by_key(spark, sf):
    seen = []
    live.keep_up(live.access_counts(live.read_events(spark, sf)), lambda batch, n: seen.extend(batch.collect()))
    want = {r["user_id"]: r["n"] for r in load(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = {}
    for r in seen:
        last[r["user_id"]] = max(last.get(r["user_id"], 0), r["access_count"])
    assert last == want


def test_stream_join(spark, sf):
    got = live.run(live.joined(live.read_events(spark, sf), live.read_events(spark, sf), "30 minutes"))
    e = load(spark, sf, "events").select("user_id", "event_id", "ts")
    want = e.alias("a").join(e.alias("b"), F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 minutes")).count()
    assert got.count() == want


def test_text_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    got = readers.text_episodes(spark, str(tmp_path / "a.txt")).collect()
    assert got[0]["content"] == "one\n\ntwo" and got[0]["source_type"] == "text"
    d = spark.createDataFrame([(1, "\n\n".join(["x" * 300] * 5)), (2, None), (3, "")], "id int, text string")
    assert [r["page"] for r in readers.pages(d, "id", "text", 700).orderBy("page").collect()] == [0, 1, 2]


def test_pdf_errors_stay_with_their_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def extract(content):
        if content == b"broken":
            raise ValueError("broken")
        return content.decode()

    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.pdf_files(spark, str(tmp_path), extract).collect()}
    assert got == {"a.pdf": ("ok", None), "b.pdf": (None, "broken")}
    assert {r["error"] for r in readers.pdf_files(spark, str(tmp_path)).collect()} == {"no extractor"}


def test_paper_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>1</id><title>A  b</title><published>2020-01-02T00:00:00Z</published><summary> s </summary></entry><entry><id>2</id><title>C</title><published>2021-01-02T00:00:00Z</published><summary>t</summary></entry></feed>")
    assert [r["title"] for r in readers.arxiv_feed(spark, str(tmp_path / "f.xml")).orderBy("title").collect()] == ["A b", "C"]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"paperId": "p", "title": "T", "year": 2020, "citationCount": 3}]}))
    assert tuple(readers.scholar_json(spark, str(tmp_path / "s.json")).first()) == ("p", "T", 2020, 3)
    (tmp_path / "e.json").write_text(json.dumps([{"question_id": "q", "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]]}]))
    assert [r["turn"] for r in readers.evaluation_set(spark, str(tmp_path / "e.json")).orderBy("turn").collect()] == [0, 1]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b")], "n int, s string")
    readers.write_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["s"] == "a_b"
    assert r"a\_b" in readers.latex([{"n": 1, "s": "a_b"}]) and readers.latex([]) == ""


@pytest.fixture
def engine(spark):
    e = spark.createDataFrame([("1", "Acme Labs", "Organization", "makes graphs")], "id string, name string, entity_type string, summary string").withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "updated_at": F.lit("2020-01-01").cast("timestamp")})
    r = spark.createDataFrame([], "id string, source_id string, target_id string, relationship_type string, fact string, confidence double, valid_from timestamp, valid_until timestamp, created_at timestamp, expired_at timestamp")
    return Engine(spark, e, r)


def test_ingest_is_idempotent_and_resolves(spark, engine):
    texts = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "id string, text string")
    engine.add_text(texts("Ann works at acme-labs", None, ""), "2021-01-01")
    assert engine.relationships.count() == 1 and engine.entities.count() == 2  # the known name is found again
    engine.add_text(texts("Ann works at acme-labs"), "2021-01-01")
    assert engine.relationships.count() == 1
    conflicts = engine.add_text(texts("Ann works at Bolt Works"), "2022-01-01")
    assert [r["conflict"] for r in conflicts.collect()] == ["contradiction"]
    assert engine.relationships.where("valid_until IS NULL").count() == 1
    assert engine.at("2021-06-01").relationships.count() == 1
    with pytest.raises(ValueError):
        engine.at("some day")


def test_questions(engine):
    kind, rows = engine.ask("Where is acme labs")
    assert kind == "local" and [r["id"] for r in rows.collect()] == ["1"]
    assert engine.context("acme labs").count() == 1


def test_router():
    r = Router(models={"a": object(), "b": object()}, prices={"a": (2, 2), "b": (1, 1)}, budget=1.0)
    assert r.route() == "b" and r.route("a") == "a"
    r.healthy["b"] = False
    assert r.route() == "a"
    r.record(0.9)
    with pytest.raises(OverBudget):
        r.record(0.2)


def test_validation(spark):
    e = spark.createDataFrame([("1", " ", "Person"), ("2", "ok", "Alien"), ("3", "n" * 600, "Person")], "id string, name string, entity_type string")
    got = {r["id"]: (r["errors"], r["warnings"]) for r in I.validate_entities(e, ["Person"]).collect()}
    assert got == {"1": ("empty name", ""), "2": ("", "unknown type"), "3": ("long name", "")}
    assert I.validate_entities(e, ["Person"], strict=True).where("id = '2'").first()["errors"] == "unknown type"
