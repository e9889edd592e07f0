"""Whole runs, reports, files and streams."""

from __future__ import annotations

import gzip
import json
import pickle
import random
import sys
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions.vectors import embed_hashed
from recordmill.operators.intake import default_doc_id, discovery_count, reject_reason
from recordmill.operators.extraction import KeyedAnswers, infer, replay
from recordmill.operators.store import LatestTable
from recordmill.plans import reports
from recordmill.plans.extraction_run import reprice, run, with_context
from recordmill.sources import files
from recordmill.streaming import ingest as ingest_module
from recordmill.streaming.inference import ask
from recordmill.streaming.ingest import ingest, last_per_key

# the model below runs in the workers, which cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AT = "2024-05-01 10:20:30"
GOOD = {"sender_name": "Ann", "receiver_name": "Bob", "subject": "Hello", "date": "today", "body": "text", "key_points": ["k"],
        "action_items": ["a"]}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("e1", "email", "e1.txt", "hello world"), ("e2", "email", "e2.txt", "bad answer"), ("e3", "email", "e3.pdf", "x"),
            ("e4", "email", "e4.txt", " \n"), ("m1", "memo", "m1.txt", "memo"), ("i1", "invoice", None, "word " * 2500)]
    return spark.createDataFrame(rows, "doc_id string, doc_type string, filename string, text string")


def make_model():
    def model(prompts):
        answers = []
        for _, user in prompts:
            if "bad answer" in user:
                answers.append(("no json", 5, 6))
            elif "sender_name" in user:
                answers.append((json.dumps(GOOD), 1000, 100))
            else:
                answers.append(('{"sender_company":"S","receiver_company":"R","line_items":[],"total_amount":-1}', 7, 8))
        return answers

    return model


@pytest.fixture(scope="module")
def results(docs, tmp_path_factory):
    return run(docs, "r1", AT, make_model=make_model, provider="openai_gpt4o_mini", answers=str(tmp_path_factory.mktemp("answers") / "a")).cache()


def test_run_keeps_every_document(results):
    got = {r["doc_id"]: r for r in results.collect()}
    assert {d: r["status"] for d, r in got.items()} == {
        "e1": "success", "e2": "failed", "e3": "failed", "e4": "failed", "m1": "failed", "i1": "success"}
    assert got["e1"]["confidence"]["avg_confidence"] == 82.9 and got["e1"]["validation"]["passed"]
    assert json.loads(got["e1"]["extraction"])["priority"] is None
    assert got["e1"]["cost_usd"] == round(1000 / 1e6 * 0.15 + 100 / 1e6 * 0.6, 6)
    # an unreadable answer keeps its tokens, a rejected document has none
    assert got["e2"]["token_usage"]["total_tokens"] == 11 and got["e2"]["error"] == "Extraction failed"
    assert got["m1"]["token_usage"]["total_tokens"] == 0 and "type" in got["m1"]["error"]
    assert got["e3"]["error"] != got["e4"]["error"]
    assert got["i1"]["use_retrieval"] and got["i1"]["context_words"] < 2500
    assert str(got["e1"]["ts"]) == AT and got["e1"]["model"] == "gpt-4o-mini"


def test_replayed_answers_give_the_same_results(docs, results, spark):
    stored = spark.createDataFrame(
        [("e1", json.dumps(GOOD), 1000, 100, None), ("e2", "no json", 5, 6, None),
         ("i1", '{"sender_company":"S","receiver_company":"R","line_items":[],"total_amount":-1}', 7, 8, None)],
        "doc_id string, raw_output string, prompt_tokens bigint, completion_tokens bigint, call_error string")
    again = run(docs, "r1", AT, responses=stored, provider="openai_gpt4o_mini")
    assert sorted(map(str, again.collect())) == sorted(map(str, results.collect()))


def test_run_needs_one_source_of_answers(docs):
    with pytest.raises(ValueError):
        run(docs, "r", AT)


def test_own_embedder_takes_the_table_route(docs):
    own = with_context(docs, embedder=embed_hashed)
    built_in = with_context(docs)
    assert sorted(map(str, own.select("doc_id", "use_retrieval", "context").collect())) == sorted(
        map(str, built_in.select("doc_id", "use_retrieval", "context").collect()))


def test_reports(results, spark):
    summary = reports.batch_summary(results).first()
    assert (summary["total"], summary["successful"], summary["failed"], summary["validation_passed"]) == (6, 2, 4, 1)
    assert summary["prompt_tokens"] == 1012 and summary["total_cost"] == 0.00022
    lines = {r["filename"]: r for r in reports.per_document(results).collect()}
    assert lines["e1.txt"]["valid"] == "Yes" and lines["e2.txt"]["marker"] == "[FAILED]"
    advice = [r["recommendation"] for r in reports.recommendations(results).sort("rule_order").collect()]
    assert any("Validation failed on: Total amount positive, Has line items" in a for a in advice)
    assert sum(a.startswith("[CRIT]") for a in advice) == 1
    assert reports.result_lookup(results, "e1").count() == 1 and reports.result_lookup(results, "zz").count() == 0
    compare = reports.cost_compare(results).sort("position").collect()
    assert [r["key"] for r in compare][0] == "openai_gpt4o_mini" and len(compare) == 8


def test_reports_of_nothing(results):
    none = results.filter("false")
    summary = reports.batch_summary(none).first()
    assert (summary["total"], summary["avg_confidence"], summary["total_cost"]) == (0, 0.0, 0.0)
    assert reports.report_summary(none).first()["avg_confidence"] == 0.0
    assert reports.cost_projection(none).first()["cost_per_1000"] == 0.0
    text = [r["line"] for r in reports.report_lines(none).sort("section", "filename", "line_no").collect()]
    assert "   No fields flagged for review!" in text


def test_written_files_come_back(results, spark, tmp_path):
    table = str(tmp_path / "runs")
    files.write_run(results, table)
    first = files.read_runs(spark, table)
    files.write_run(reprice(first, "r2", AT, "anthropic_haiku"), table)
    files.write_run(reprice(files.read_runs(spark, table).filter("run_id = 'r1'"), "r2", AT, "groq"), table)
    runs = files.read_runs(spark, table)
    assert {r["run_id"]: r["n"] for r in runs.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"r1": 6, "r2": 6}
    assert {r["provider"] for r in files.latest_run(spark, table).collect()} == {"groq"}
    files.write_json(results, str(tmp_path / "json"))
    back = files.read_json(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.select("doc_id", "validation", "cost_usd", "extraction").collect())) == sorted(
        map(str, results.select("doc_id", "validation", "cost_usd", "extraction").collect()))
    files.write_csv(results, str(tmp_path / "csv"))
    rows = {r["filename"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert rows["e1.txt"]["validation_passed"] == "True" and rows["e2.txt"]["avg_confidence"] == "N/A"


def test_result_texts_are_packed_and_plain_ones_are_read(results, spark, tmp_path):
    path = tmp_path / "json"
    files.write_json(results, str(path))
    files.write_csv(results, str(tmp_path / "csv"))
    files.write_run(results, str(tmp_path / "runs"))
    written = [f.name for d in ("json", "csv") for f in (tmp_path / d).rglob("part-*")]
    assert written and all(n.endswith((".json.gz", ".csv.gz")) for n in written)
    assert all(".zstd." in f.name for f in (tmp_path / "runs").rglob("part-*"))
    # rows go to the files of their run without being sorted first
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "16"
    one = next(path.rglob("part-*.json.gz"))
    one.with_suffix("").write_bytes(gzip.decompress(one.read_bytes()))
    one.unlink()
    (one.parent / "notes.jsonx").write_text("x")
    assert sorted(r[0] for r in files.read_json(spark, str(path)).select("doc_id").collect()) == sorted(
        r[0] for r in results.select("doc_id").collect())


def test_report_is_in_order_in_one_file_or_many(results, spark, tmp_path):
    def written(name, one_file):
        reports.write_report(results, str(tmp_path / name), one_file)
        parts = sorted((tmp_path / name).glob("part-*"))
        assert (tmp_path / name / "_SUCCESS").exists()
        return len(parts), [line for p in parts for line in p.read_text(encoding="utf-8").splitlines()]

    (one, lines), (many, same) = written("one", 10**6), written("many", 0)
    assert one == 1 and many >= 1 and lines == same
    assert lines == [r["line"] for r in reports.report_lines(results).orderBy("section", "filename", "line_no").collect()]
    assert lines[:5] == ["=" * 65, "INTELLIGENT DOCUMENT PROCESSOR", "   Batch Processing Report", f"   Generated: {AT}", "=" * 65]
    assert lines[-3:] == ["=" * 65, "Report complete.", "=" * 65]
    table = lines.index("PER-DOCUMENT BREAKDOWN")
    assert lines[table + 2].split() == ["File", "Type", "Valid", "Conf", "Review"] and set(lines[table + 3]) == {"─"}
    assert [w for w in map(lines.index, ("OVERALL STATISTICS", "RECOMMENDATIONS", "COST ANALYSIS", "  Actual cost (Groq)        : $0.0000 (free tier)"))] == sorted(
        map(lines.index, ("OVERALL STATISTICS", "RECOMMENDATIONS", "COST ANALYSIS", "  Actual cost (Groq)        : $0.0000 (free tier)")))
    # a scored document that is not a success, and one without scored fields
    odd = results.filter("confidence is not null").withColumns({"status": F.lit("failed"), "confidence": F.col("confidence").withField(
        "field_scores", F.expr("cast(map() as map<string,int>)"))})
    found = [r["line"] for r in reports.report_lines(odd).filter("section = 3").collect()]
    assert any(line.endswith(" [validation failed]") for line in found) and "   No field scores available" in found


def test_latest_run_reads_one_partition(results, spark, tmp_path):
    table = str(tmp_path / "runs")
    files.write_run(results, table)
    plan = files.latest_run(spark, table).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "(run_id" in plan and "= r1)" in plan and "Subquery" not in plan


def test_text_folder(spark, tmp_path):
    for folder, name, data in [("invoices", "b.txt", b"one\r\ntwo"), ("invoices", "a b.txt", "é".encode()), ("emails", "c.txt", b"\xff\xfe"),
                               ("emails", "skip.md", b"x"), ("notes", "d.txt", b"x")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    got = {r["filename"]: (r["doc_type"], r["readable"], r["text"]) for r in files.read_text_folder(spark, str(tmp_path)).collect()}
    assert got == {"b.txt": ("invoice", True, "one\ntwo"), "a b.txt": ("invoice", True, "é"), "c.txt": ("email", False, None)}


def test_text_folder_is_written_file_by_file_without_checksums(spark, tmp_path):
    docs = spark.createDataFrame(pa.table({"doc_type": ["invoice", "invoice", "email", "memo", "resume"], "text": ["é\r\nb", None, "", "x", "y"]}))
    path = str(tmp_path / "folder")
    files.write_text_folder(docs.filter("false"), path)
    assert files.read_text_folder(spark, path).count() == 0
    files.write_text_folder(docs, path)
    files.write_text_folder(docs.filter("doc_type = 'email'"), f"file:{path}")
    got = sorted((r["doc_type"], r["text"]) for r in files.read_text_folder(spark, path).collect())
    assert got == [("email", "\n"), ("email", "\n"), ("invoice", "\n"), ("invoice", "é\nb\n"), ("resume", "y\n")]
    # a checksum file beside each text shows Hadoop's local client, which starts processes for every file
    assert not [p for p in (tmp_path / "folder").rglob(".*.txt*")] and len(list((tmp_path / "folder").rglob("*.txt"))) == 5


def test_text_folder_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    for folder in ("invoices", "deep/x y/folder=emails", "_off/resumes", ".off/emails", "a=b/_c=d/resumes", "notes"):
        (tmp_path / folder).mkdir(parents=True)
        for name, data in (("a b.txt", b"x\r\ny"), ("\u00e9.txt", b"\xff"), ("_u.txt", b"u"), ("_u=1.txt", b"v"), (".d.txt", b"w"), ("empty.txt", b""), ("x.md", b"z")):
            (tmp_path / folder / name).write_bytes(data)
    (tmp_path / "deep" / "resumes").symlink_to(tmp_path / "invoices")
    ours = files.read_text_folder(spark, f"file:{tmp_path}")
    # the driver knows no file
    assert ours.inputFiles() == []
    found = sorted(map(str, ours.collect()))
    monkeypatch.setattr(files, "_local", lambda *_: None)
    theirs = files.read_text_folder(spark, f"file:{tmp_path}")
    assert len(theirs.inputFiles()) > 0 and len(found) == 12 and found == sorted(map(str, theirs.collect()))


def test_gate_order_and_ids(spark):
    rows = spark.createDataFrame(pa.table({
        "filename": ["a.pdf", "a.txt", "a.txt", None, None], "text": ["", "x", " ", "x", "x"],
        "doc_type": ["memo", "memo", "memo", "memo", "email"], "content": [b"\xff", b"\xff", b" ", b"x", b"x"],
        "doc_id": [None, "", "given", "", None]}))
    got = rows.select(reject_reason(F.col("filename"), "text", F.col("doc_type"), F.col("content")).alias("r"),
                      default_doc_id(F.col("doc_id"), F.col("doc_type"), F.col("text"), F.col("filename")).alias("i")).collect()
    assert [r["r"] for r in got] == ["extension", "encoding", "blank", "doc_type", None]
    assert [r["i"][:7] for r in got] == ["a.pdf", "a", "given", "memo_2d", "email_2"]


def test_discovery_counts_absent_types(spark):
    rows = spark.createDataFrame([("email",), ("email",), ("memo",)], "doc_type string")
    assert {tuple(r) for r in discovery_count(rows).collect()} == {("invoice", 0), ("resume", 0), ("email", 2)}


class _State:
    """A group's state in memory, which counts calls."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value


def test_versions_are_kept_in_slots(monkeypatch):
    monkeypatch.setattr(ingest_module, "HELD_SLOTS", 5)
    state, newest, pick = _State(), ingest_module._Newest("k", "v"), random.Random(3)
    newest.init(state)
    known: dict = {}
    for size in (3000, 40, 0, 2000, 5, 6000):
        rows = [{"k": pick.choice([None, f"key {pick.randrange(9000)}"]) if i % 50 == 0 else f"key {pick.randrange(9000)}", "v": pick.choice([None, 1, 2, 3])} for i in range(size)]
        expected = []
        for row in rows:
            before = known.get(row["k"])
            if row["k"] is None or before is None or (row["v"] is not None and row["v"] >= before):
                known[row["k"]] = row["v"]
                expected.append(row)
        known.pop(None, None)
        state.calls = 0
        assert list(newest.handleInputRows(0, iter(rows), None)) == expected
        if size == 3000:
            assert state.calls < 100  # a call for each key is what takes the time
    bits, keys = state.value
    assert keys == len(known) and keys <= ingest_module.SLOT_KEYS << bits
    slots = {k[0]: pickle.loads(v[0]) for k, v in state.entries.items()}
    assert {k: v for own in slots.values() for k, v in own.items()} == known
    assert all(newest.slot(k, bits) == slot for slot, own in slots.items() for k in own)


def test_stream_equals_batch_and_replaces(docs, results, spark, tmp_path):
    source = str(tmp_path / "in")
    schema = T.StructType([*results.schema.fields, T.StructField("n", T.IntegerType())])
    stored = LatestTable(spark, str(tmp_path / "out"), "doc_id", "n", schema)

    def transform(batch):
        return run(batch, "r1", AT, make_model=make_model, provider="openai_gpt4o_mini", answers=str(tmp_path / "answers"), carry=("n",))

    def feed(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ingest(stream, transform, stored, str(tmp_path / "cp")).awaitTermination()

    feed(docs.withColumn("n", F.lit(1)))
    columns = ["doc_id", "status", "error", "cost_usd", "validation", "context_words"]
    assert sorted(map(str, stored.read().select(*columns).collect())) == sorted(map(str, results.select(*columns).collect()))
    # e2 comes in twice in one batch; its last submission counts
    again = docs.filter("doc_id = 'e2'").withColumn("n", F.lit(1)).unionByName(
        docs.filter("doc_id = 'e2'").withColumns({"text": F.lit("fine now"), "n": F.lit(2)}))
    feed(again)
    got = {r["doc_id"]: r["status"] for r in stored.read().collect()}
    assert got["e2"] == "success" and len(got) == 6
    # an older submission in a later batch changes nothing
    feed(docs.filter("doc_id = 'e2'").withColumn("n", F.lit(0)))
    assert {r["doc_id"]: r["status"] for r in stored.read().collect()} == got


def test_rejected_documents_are_not_processed(spark):
    long = spark.createDataFrame([("a", "memo", "a.pdf", "word " * 2500)], "doc_id string, doc_type string, filename string, text string")
    row = run(long, "rejected", AT, make_model=make_model).first()
    assert (row["use_retrieval"], row["context_words"], row["status"]) == (False, 0, "failed")


def test_one_answer_for_each_id(spark, docs):
    stored = spark.createDataFrame([("e1", "old", 1, 1, None, 1), ("e1", "new", 2, 2, None, 2), ("e1", "older", 3, 3, None, 0)],
                                   "doc_id string, raw_output string, prompt_tokens bigint, completion_tokens bigint, call_error string, n int")
    rows = replay(docs.select("doc_id", "doc_type"), stored, "n").collect()
    assert len(rows) == docs.count() and [r["raw_output"] for r in rows if r["doc_id"] == "e1"] == ["new"]
    assert replay(docs.select("doc_id"), stored).count() == docs.count()


def test_a_second_run_asks_nobody(spark, docs, results, tmp_path):
    def no_model():
        raise AssertionError("the answers are there")

    path = str(tmp_path / "answers")
    first = run(docs, "r1", AT, make_model=make_model, provider="openai_gpt4o_mini", answers=path)
    again = run(docs, "r1", AT, make_model=no_model, provider="openai_gpt4o_mini", answers=path)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) == sorted(map(str, results.collect()))


def test_an_outage_ends_a_batch_soon(spark):
    calls = spark.sparkContext.accumulator(0)

    def broken():
        def model(prompts):
            calls.add(1)
            raise RuntimeError("down")

        return model

    rows = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"))
    assert [r["call_error"] for r in infer(rows, broken).collect()] == ["down"] * 64
    assert calls.value == 4


def test_last_per_key_under_a_hot_key(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    got = last_per_key(rows, "key", "id")
    assert got.count() == 10001 and got.filter("key = 'hot'").first()["id"] == 29999


def test_refused_prompts_cost_no_others(spark, tmp_path):
    def picky():
        def model(prompts):
            if any("refuse me" in user for _, user in prompts):
                raise RuntimeError("refused")
            return [(json.dumps(GOOD), 1, 1) for _ in prompts]

        return model

    rows = spark.createDataFrame([(f"e{i}", "email", f"e{i}.txt", "refuse me" if i % 2 else "hello") for i in range(60)], "doc_id string, doc_type string, filename string, text string").coalesce(1)
    path = str(tmp_path / "a")
    got = {r["doc_id"]: r["status"] for r in run(rows, "r", AT, make_model=picky, provider="openai_gpt4o_mini", answers=path).collect()}
    assert got == {f"e{i}": "failed" if i % 2 else "success" for i in range(60)}
    # a failed call is repeated by a run that starts again
    again = run(rows, "r", AT, make_model=make_model, provider="openai_gpt4o_mini", answers=path)
    assert {r["status"] for r in again.collect()} == {"success"}


def test_a_stream_leaves_no_copies_and_its_results_are_not_exchanged_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 40), i, "t" * 50) for i in range(80)], "id string, n int, text string")
    store = LatestTable(spark, str(tmp_path / "out"), "id", "n", rows.schema)
    rows.write.parquet(str(tmp_path / "in"))
    left = []

    def transform(batch):
        left.extend(f for f in batch.inputFiles())
        return batch

    ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), transform, store, str(tmp_path / "cp"), buckets=3).awaitTermination()
    assert left and not [f for f in left if Path(unquote(f.removeprefix("file:"))).exists()]
    assert sorted(map(tuple, store.read().collect())) == sorted((str(i % 40), i, "t" * 50) for i in range(40, 80))
    # several tasks write to their buckets, and these are still read without an exchange
    store.append(rows.repartition(4), "later")
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "out" / "batch=later").glob("*.parquet"))) > store.buckets and "Exchange hashpartitioning" not in plan


def test_stored_answers_are_exchanged_and_sorted_once(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1, None), ("a", "y", 1, 1, None), (None, "z", 1, 1, None)],
                                 "doc_id string, raw_output string, prompt_tokens bigint, completion_tokens bigint, call_error string")
    got = replay(spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string"), rows)
    assert sorted(((r["doc_id"], r["raw_output"], r["call_error"]) for r in got.collect()), key=str) == [
        ("a", "y", None), ("b", None, "no response"), (None, None, "no response")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "REPARTITION")


def test_stream_keeps_what_has_no_key_or_version(spark, tmp_path):
    schema = "id string, n int, text string"
    store = LatestTable(spark, str(tmp_path / "out"), "id", "n", spark.createDataFrame([], schema).schema)
    seen = []

    def transform(batch):
        seen.append(sorted(map(tuple, batch.collect()), key=str))
        return batch

    waves = [
        [(None, None, "a"), (None, None, "b"), (None, 3, "a"), ("x", None, "first"), ("y", 5, "new"), ("y", None, "unversioned"), ("z", 1, "z1")],
        [("x", None, "second"), ("y", 4, "late"), ("y", None, "late"), ("z", 2, "z2"), (None, None, "a")],
        [("x", 1, "third"), ("z", 2, "z2 again"), ("z", 1, "late")],
        [("x", None, "late"), ("y", 4, "late")],
    ]
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, transform, store, str(tmp_path / "cp"), buckets=3).awaitTermination()
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted([
        (None, None, "a"), (None, None, "b"), (None, 3, "a"), (None, None, "a"), ("x", 1, "third"), ("y", 5, "new"), ("z", 2, "z2 again")], key=str)
    # late submissions were dropped before the run, and only the last of a key in a batch was transformed
    assert seen == [
        sorted([(None, None, "a"), (None, None, "b"), (None, 3, "a"), ("x", None, "first"), ("y", 5, "new"), ("z", 1, "z1")], key=str),
        sorted([("x", None, "second"), ("z", 2, "z2"), (None, None, "a")], key=str), [("x", 1, "third"), ("z", 2, "z2 again")], []]


def test_a_batch_without_the_key_is_an_error(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "id string, n int").write.parquet(str(tmp_path / "in"))
    store = LatestTable(spark, str(tmp_path / "out"), "id", "n", spark.createDataFrame([], "id string, n int").schema)
    stream = spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="carry"):
        ingest(stream, lambda batch: batch.drop("n"), store, str(tmp_path / "cp"), buckets=1).awaitTermination()


def test_answers_by_key_read_only_their_folders(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("d%d", F.col("id") % 1000).alias("doc_id"), F.col("id").cast("string").alias("raw_output"),
                                    F.col("id").alias("prompt_tokens"), F.col("id").alias("completion_tokens"), F.lit(None).cast("string").alias("call_error"), "id")
    answers = KeyedAnswers(spark, str(tmp_path / "answers"), parts=16).write(rows, "id")
    asked = spark.createDataFrame([("d5",), ("d5",), ("d7",), (None,), ("missing",)], "doc_id string")
    needed = {r[0] for r in asked.filter("doc_id is not null").select(answers._part()).distinct().collect()}
    for part in set(range(16)) - needed:
        folder = tmp_path / "answers" / f"part={part}"
        for file in folder.iterdir():
            # nobody can read this
            file.write_bytes(b"")
    got = sorted((r.doc_id or "", r.raw_output, r.call_error) for r in replay(asked, answers).collect())
    assert got == [("", None, "no response"), ("d5", "1005", None), ("d5", "1005", None), ("d7", "1007", None), ("missing", None, "no response")]
    assert replay(asked.limit(0), answers).count() == 0


def test_a_task_that_dies_repeats_one_wave(spark, tmp_path):
    """The first life of a task dies after some calls; the second goes on behind what was answered."""
    calls, fuse = str(tmp_path / "calls"), tmp_path / "fuse"
    fuse.write_text("")

    def noted():
        import os

        def model(prompts):
            with open(calls, "a") as f:
                f.writelines(f"{user}\n" for _, user in prompts)
            if any(user == "prompt 333" for _, user in prompts) and os.path.exists(fuse):
                os.remove(fuse)
                os._exit(1)
            return [("answer to " + user, 1, 1) for _, user in prompts]

        return model

    prompts = spark.range(640).select(F.format_string("k%d", "id").alias("prompt_key"), F.lit("s").alias("system_prompt"),
                                      F.format_string("prompt %d", "id").alias("user_prompt")).coalesce(1)
    path = str(tmp_path / "asked")

    def run_all():
        return ask(prompts, noted, path, batch=8, file_prompts=32, wave_files=4)

    with pytest.raises(Exception):
        run_all()
    got = {r.prompt_key: r.raw_output for r in run_all().collect()}
    assert got == {f"k{i}": f"answer to prompt {i}" for i in range(640)}
    made = (tmp_path / "calls").read_text().splitlines()
    assert len(set(made)) == 640 and len(made) <= 640 + 4 * 32
    # a third run asks nobody
    run_all()
    assert (tmp_path / "calls").read_text().splitlines() == made


def test_prompts_given_up_are_asked_again(spark, tmp_path):
    """A model that is down for a while: what was not called is asked in a later drain."""

    def shaky():
        def model(prompts):
            if any("5" in user for _, user in prompts):
                raise RuntimeError("refused")
            return [(user, 1, 1) for _, user in prompts]

        return model

    prompts = spark.range(60).select(F.col("id").cast("string").alias("prompt_key"), F.lit("s").alias("system_prompt"),
                                     F.when(F.col("id") != 33, F.col("id").cast("string")).alias("user_prompt")).coalesce(1)
    got = {r.prompt_key: (r.raw_output, r.call_error) for r in ask(prompts, shaky, str(tmp_path / "a"), batch=20, file_prompts=20).collect()}
    assert got == {str(i): (None, "no prompt") if i == 33 else (None, "refused") if "5" in str(i) else (str(i), None) for i in range(60)}

    def broken():
        def model(prompts):
            raise RuntimeError("down")

        return model

    failed = ask(prompts.filter("user_prompt is not null"), broken, str(tmp_path / "b"), batch=20, file_prompts=20).collect()
    assert len(failed) == 59 and all(r.call_error == "down" for r in failed)
