import json
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from recordgauge import (
    DEFAULT,
    Contract,
    ContractViolation,
    accepted,
    annotate,
    assert_conforms,
    check,
    check_and_keep,
    compact,
    gate,
    missing_fields,
    problem_report,
    quarantined,
    read_events,
    read_split,
    split,
    spread,
    stream_events,
    tallied,
    tally,
    vocabulary_check,
    write_split,
    write_split_stream,
)
from recordgauge.operators.split import listed_batches
from recordgauge.plans.scratch import discard, scratch_path, staged
from tests.test_annotate import SAMPLE
from tests.truth import truth_table

TABLE = truth_table()
GOOD = next(t["v"] for t in TABLE if t["case"] == "ok")


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(t["case"], t["v"]) for t in TABLE], "case string, v string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return annotate(spark.createDataFrame([], "case string, v string"))


def names(df):
    return sorted(r["case"] for r in df.select("case").collect())


def expected_gate():
    checked = [t for t in TABLE if t["status"] == "checked"]
    valid = sum(t["problems"] == [] for t in checked)
    return (
        len(TABLE),
        valid,
        len(checked) - valid,
        sum(t["status"] == "not_object" for t in TABLE),
        sum(t["status"] == "malformed" for t in TABLE),
        False,
    )


def expected_report():
    lists = [t["problems"] for t in TABLE if t["problems"]]
    return {p: (sum(p in x for x in lists), sum(x.count(p) for x in lists)) for p in set(sum(lists, []))}


def report_rows(df):
    return {r["problem"]: (r["n_records"], r["n_occurrences"]) for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- Split ---


def test_split_is_complete(records):
    good, bad = split(annotate(records))
    assert names(good) == sorted(t["case"] for t in TABLE if t["problems"] == [])
    assert sorted(names(good) + names(bad)) == sorted(t["case"] for t in TABLE)


def test_written_split(spark, records, tmp_path):
    path = str(tmp_path / "out")
    annotated = annotate(records)
    write_split(annotated, path)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["status=checked", "status=malformed", "status=not_object"]
    for kept in (read_split(spark, path), read_split(spark, path, annotated.schema)):
        assert dict(kept.dtypes)["valid"] == "boolean"
        assert names(accepted(kept)) == names(accepted(annotated))
        assert names(quarantined(kept)) == names(quarantined(annotated))
        got = {r["case"]: (r["v"], r["status"], r["problems"]) for r in kept.collect()}
        assert got == {t["case"]: (t["v"], t["status"], t["problems"]) for t in TABLE}


def test_written_sides_read_their_own_directories(spark, records, tmp_path):
    path = str(tmp_path / "out")
    annotated = annotate(records)
    write_split(annotated, path)
    for kept in (read_split(spark, path), read_split(spark, path, annotated.schema)):
        files = {r[0] for r in accepted(kept).select(F.input_file_name()).distinct().collect()}
        assert files and all("/status=checked/valid=true/" in f for f in files)
        scan = plan(accepted(kept).select("case")).split("FileScan")[1]
        assert "PartitionFilters: []" not in scan and "valid" in scan.split("PartitionFilters")[1]


def test_write_refuses_an_existing_path_unless_told(records, tmp_path):
    path = str(tmp_path / "out")
    write_split(annotate(records), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_split(annotate(records), path)
    write_split(annotate(records), path, mode="overwrite")


def test_writing_shuffles_nothing(records):
    assert "Exchange" not in plan(annotate(records))


def test_even_files(spark, tmp_path):
    many = spark.range(0, 4000, numPartitions=20).select(F.when(F.col("id") % 3 == 0, GOOD).otherwise("{").alias("v"))
    for even in (False, True):
        write_split(annotate(many), str(tmp_path / str(even)), even_files=even)
    files = {
        even: len(read_split(spark, str(tmp_path / str(even))).inputFiles()) for even in (False, True)
    }
    assert files[False] == 40 and files[True] <= 4
    assert accepted(read_split(spark, str(tmp_path / "True"))).count() == 1334
    assert read_split(spark, str(tmp_path / "True")).count() == 4000


def test_even_files_need_adaptive_execution(spark, records, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(ValueError, match="adaptive"):
            write_split(annotate(records), str(tmp_path / "out"), even_files=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_split(spark, empty, tmp_path):
    path = str(tmp_path / "out")
    write_split(empty, path)
    assert read_split(spark, path, empty.schema).count() == 0


# --- Gate and report ---


def test_gate(records):
    assert tuple(gate(annotate(records)).first()) == expected_gate()


def test_gate_schema(records):
    assert gate(annotate(records)).dtypes == [
        ("n_records", "bigint"),
        ("n_valid", "bigint"),
        ("n_invalid", "bigint"),
        ("n_not_object", "bigint"),
        ("n_malformed", "bigint"),
        ("conforms", "boolean"),
    ]


def test_gate_of_nothing(empty):
    assert tuple(gate(empty).first()) == (0, 0, 0, 0, 0, True)
    assert problem_report(empty).collect() == []


def test_report(records):
    report = problem_report(annotate(records))
    assert report.dtypes == [("problem", "string"), ("n_records", "bigint"), ("n_occurrences", "bigint")]
    assert report_rows(report) == expected_report()


def test_report_of_a_single_valid_record(spark):
    assert problem_report(annotate(spark.createDataFrame([(GOOD,)], "v string"))).collect() == []


def test_tally(records):
    rows = tally(annotate(records)).collect()
    assert sum(r.n for r in rows) == len(TABLE)
    assert len(rows) == len({(t["status"], tuple(t["problems"] or [])) for t in TABLE})


def _wide(spark, names, records=4_000):
    """A contract of many names and records that each lack others of them."""
    contract = Contract(tuple(f"f{i}" for i in range(names)), "f3", ("w",))
    given = ", ".join(f"IF(hash(id, {i}) % 2 = 0, '\"f{i}\":0,', '')" for i in range(names))
    many = spark.range(0, records, numPartitions=5).selectExpr(f"concat('{{', {given}, '\"x\":0}}') AS v")
    return contract, annotate(many, contract)


def test_report_is_counted_by_name_however_problems_combine(spark):
    contract, annotated = _wide(spark, 40)
    assert tally(annotated).count() > 3_900
    lists = [r.problems for r in annotated.collect()]
    expected = {n: (sum(n in x for x in lists), sum(x.count(n) for x in lists)) for n in contract.required}
    assert report_rows(problem_report(annotated, contract)) == expected
    counted = tallied(annotated, contract)
    assert report_rows(counted.where("problem IS NOT NULL").drop("status", "valid")) == expected
    # Before the shuffle a task has a row for each name and verdict at most.
    partial = annotated.select(F.spark_partition_id().alias("p"), F.explode("problems").alias("problem")).distinct()
    assert partial.count() <= 5 * 40
    assert "partial_count" in plan(counted) and "partial_count" in plan(problem_report(annotated, contract))


def test_report_of_500_names_is_generated_code(spark, tmp_path):
    contract, annotated = _wide(spark, 500, 200)
    report = problem_report(annotated, contract)
    rows = report_rows(report)
    assert len(rows) == 500 and 50 < rows["f0"][0] < 150
    # No record has a known word: f3 is listed once for each, and again where it is missing.
    missing = sum("f3" in r.problems[:-1] for r in annotated.collect())
    assert rows["f3"] == (200, 200 + missing)
    text = plan(report)
    assert re.search(r"\*\(\d+\) Generate posexplode", text) and re.search(r"\*\(\d+\) HashAggregate", text)


def test_check(records):
    outcome = check(records)
    assert tuple(outcome.gate.first()) == expected_gate()
    assert report_rows(outcome.report) == expected_report()
    assert "parseJson" not in plan(outcome.gate) + plan(outcome.report)  # nothing is parsed again


def test_check_leaves_nothing_behind(spark, records):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = sorted(os.listdir(shared))
    check(records), check(records)
    assert sorted(os.listdir(shared)) == before


def test_check_of_nothing(spark):
    outcome = check(spark.createDataFrame([], "v string"))
    assert tuple(outcome.gate.first()) == (0, 0, 0, 0, 0, True)
    assert outcome.report.collect() == []


def test_check_and_keep(records, tmp_path):
    kept, outcome = check_and_keep(records, str(tmp_path / "out"))
    assert tuple(outcome.gate.first()) == expected_gate()
    assert report_rows(outcome.report) == expected_report()
    assert names(kept) == names(records)
    # The verdict is taken from the verdict columns; the texts are not read again.
    assert "v:string" not in plan(tally(kept))


def test_hot_verdict_is_counted_before_the_shuffle(spark):
    hot = spark.range(0, 50_000, numPartitions=8).select(F.lit("{}").alias("v"))
    assert report_rows(problem_report(annotate(hot))) == {
        n: (50_000, 100_000 if n == "kind" else 50_000) for n in DEFAULT.required
    }
    assert "partial_count" in plan(problem_report(annotate(hot)))


def test_single_rules(records):
    for t, r in zip(TABLE, missing_fields(records).collect()):
        expected = None if t["problems"] is None else t["problems"][: -1 if t["problems"][-1:] == ["kind"] else None]
        assert (r.status, r.missing) == (t["status"], expected), t["case"]
    for t, r in zip(TABLE, vocabulary_check(records).collect()):
        expected = None if t["problems"] is None else t["problems"][-1:] == ["kind"]
        assert (r.status, r.unknown_word) == (t["status"], expected), t["case"]


def test_assert_conforms(spark, records):
    assert_conforms(annotate(spark.createDataFrame([(GOOD,)], "v string")))
    with pytest.raises(ContractViolation, match=f"n_records={len(TABLE)}"):
        assert_conforms(annotate(records))
    for text in ("5", "{", None, "{}"):
        with pytest.raises(AssertionError):
            assert_conforms(annotate(spark.createDataFrame([(GOOD,), (text,)], "v string")))


# --- Plans ---


@pytest.mark.parametrize(
    "job", [lambda a: a, accepted, quarantined, gate, problem_report, tally], ids="annotate accepted quarantined gate report tally".split()
)
def test_every_job_parses_once(records, job):
    text = plan(job(annotate(records)))
    # Once for the record, once under the condition that the record holds the end mark.
    assert text.count("parseJson(") == 2 and "from_json(" not in text
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_verdict_is_generated_code(spark, records, tmp_path):
    records.write.parquet(str(tmp_path / "in"))
    text = plan(accepted(annotate(spark.read.parquet(str(tmp_path / "in")))))
    assert re.search(r"\*\(\d+\) Filter", text) and re.search(r"\*\(\d+\) Generate inline", text)
    assert "ReadSchema: struct<case:string,v:string>" in text


def test_only_needed_columns_are_read(spark, records, tmp_path):
    records.withColumn("other", F.lit(1)).write.parquet(str(tmp_path / "in"))
    assert "ReadSchema: struct<v:string>" in plan(gate(annotate(spark.read.parquet(str(tmp_path / "in")))))


# --- Sources ---


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes((GOOD + "\r\n" + GOOD.replace(",", ",\r", 1) + "\n\n{\n").encode())
    rows = annotate(read_events(spark, str(tmp_path))).collect()
    assert sorted(r.status for r in rows) == ["checked", "checked", "malformed", "malformed"]
    assert sum(bool(r.valid) for r in rows) == 2


def test_documents(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=2").mkdir()
    (tmp_path / "day=1" / "a.json").write_text(SAMPLE, encoding="utf-8")
    (tmp_path / "day=1" / "b.json").write_text(SAMPLE + SAMPLE, encoding="utf-8")
    (tmp_path / "day=2" / "c.json").write_text("﻿" + SAMPLE, encoding="utf-8")
    (tmp_path / "day=2" / "d.json").write_text(SAMPLE.replace("kind", "sort"), encoding="utf-8")
    df = annotate(read_events(spark, str(tmp_path), "document"))
    assert sorted((r.day, r.status, r.valid) for r in df.collect() if r.valid is not None) == [
        (1, "checked", True),
        (2, "checked", False),
    ]
    assert df.filter("status = 'malformed'").count() == 2


def test_sample_document_conforms(spark, tmp_path):
    (tmp_path / "sample.json").write_text(SAMPLE, encoding="utf-8")
    assert_conforms(annotate(read_events(spark, str(tmp_path / "sample.json"), "document")))


def test_bytes_that_are_not_utf8(spark, tmp_path):
    damaged = GOOD.encode().replace(b'"s"', b'"\xff\xfe"')
    (tmp_path / "a.json").write_bytes(damaged)
    (tmp_path / "b.json").write_bytes(GOOD.encode().replace(b"CATALOG_FROZEN", b"CATALOG_FROZEN\xff"))
    rows = annotate(read_events(spark, str(tmp_path), "document")).collect()
    assert sorted((r.status, r.problems) for r in rows) == [("checked", []), ("checked", ["kind"])]


def test_spread(spark):
    dealt = spread(spark.range(1000, numPartitions=1), 6)
    assert dealt.rdd.getNumPartitions() == 6 and dealt.count() == 1000


def test_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="layout"):
        read_events(spark, str(tmp_path), "csv")


# --- Streams ---


def _lines():
    return [(t["case"], t["v"]) for t in TABLE if t["v"] and "\n" not in t["v"]]


def _run(annotated, path, checkpoint):
    query = write_split_stream(annotated, path, checkpoint, available_now=True)
    query.awaitTermination()
    return query


def test_stream_gives_the_verdicts_of_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = [v for _, v in _lines()]
    for i in range(4):
        (source / f"{i}.jsonl").write_text("".join(t + "\n" for t in texts[i::4]), encoding="utf-8")
    annotated = annotate(stream_events(spark, str(source), max_files_per_trigger=1))
    query = _run(annotated, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4

    def rows(df):
        return sorted((r.v, r.status, r.problems or [], r.valid is None or r.valid) for r in df.collect())

    streamed = read_split(spark, str(tmp_path / "out"), annotated.schema)
    assert rows(streamed) == rows(annotate(read_events(spark, str(source))))


def test_stream_continues_without_doubling(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    (source / "a.jsonl").write_text(GOOD + "\n{}\n")
    _run(annotate(stream_events(spark, str(source))), out, progress)
    _run(annotate(stream_events(spark, str(source))), out, progress)
    assert read_split(spark, out).count() == 2
    (source / "b.jsonl").write_text(GOOD + "\n")
    _run(annotate(stream_events(spark, str(source))), out, progress)
    kept = read_split(spark, out)
    assert (kept.count(), accepted(kept).count()) == (3, 2)
    # A batch whose commit is lost is run again under its number and replaces its files.
    os.remove(os.path.join(progress, "commits", "1"))
    crc = os.path.join(progress, "commits", ".1.crc")
    if os.path.exists(crc):
        os.remove(crc)
    _run(annotate(stream_events(spark, str(source))), out, progress)
    assert read_split(spark, out).count() == 3
    assert sorted(os.listdir(out)) == ["stream_batch=0", "stream_batch=1"]
    assert not any("_spark_metadata" in d for d, _, _ in os.walk(out))


def _batches(spark, out, n, first=0):
    """Directories as a stream writes them: batch i has one good record and i broken ones."""
    for i in range(first, first + n):
        rows = spark.createDataFrame([(i, GOOD)] + [(i, "{")] * (i % 3), "i int, v string").coalesce(1)
        annotate(rows).write.partitionBy("status", "valid").parquet(f"{out}/stream_batch={i}")


def _directories(out):
    return sorted(d for d in os.listdir(out) if not d.startswith((".", "_")))


def test_compaction_of_200_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    _batches(spark, out, 3)
    for i in range(3, 200):
        shutil.copytree(f"{out}/stream_batch={i % 3}", f"{out}/stream_batch={i}")
    schema = annotate(spark.createDataFrame([(0, GOOD)], "i int, v string")).schema

    def rows():
        return sorted(tuple(r) for r in read_split(spark, out, schema).groupBy("i", "status", "valid").count().fillna(False).collect())

    before = rows()
    made = compact(spark, out, 8)
    # 24 of 8, three of 64, and what is not due: batches 192 to 199, of which the last is open.
    assert made[-1] == "stream_batch=128-191" and len(made) == 27
    assert rows() == before
    read = read_split(spark, out)
    assert len({f.split("stream_batch=")[1].split("/")[0] for f in read.inputFiles()}) == 3 + 8
    # Whoever listed before still finds the parts; the next call takes them away.
    assert len(_directories(out)) == 200 + 27
    assert compact(spark, out, 8) == [] and rows() == before
    assert len(_directories(out)) == 3 + 8
    # Closed by the next batch.
    shutil.copytree(f"{out}/stream_batch=199", f"{out}/stream_batch=200")
    assert compact(spark, out, 8) == ["stream_batch=192-199"]


def test_a_cut_off_compaction_is_made_again(spark, tmp_path):
    out = str(tmp_path / "out")
    _batches(spark, out, 4)
    shutil.copytree(f"{out}/stream_batch=0", f"{out}/_compacting-x")
    assert read_split(spark, out).count() == 4 + 1 + 2
    assert compact(spark, out, 3) == ["stream_batch=0-2"]
    assert read_split(spark, out).count() == 4 + 1 + 2
    assert "_compacting-x" not in os.listdir(out)
    with pytest.raises(ValueError):
        compact(spark, out, 1)


def test_stream_compacts_and_a_repeated_batch_replaces_itself(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for i in range(5):
        (source / f"{i}.jsonl").write_text((GOOD + "\n") * (i + 1))

    def run():
        annotated = annotate(stream_events(spark, str(source), max_files_per_trigger=1))
        query = write_split_stream(annotated, out, progress, available_now=True, fan_in=2)
        query.awaitTermination()
        return read_split(spark, out, annotated.schema).count()

    assert run() == 15
    for name in ("4", ".4.crc"):
        if os.path.exists(os.path.join(progress, "commits", name)):
            os.remove(os.path.join(progress, "commits", name))
    assert run() == 15
    assert listed_batches(os.listdir(out)).live[-1].name == "stream_batch=4"
    # Set back further, the merged batches would be doubled.
    for name in os.listdir(os.path.join(progress, "commits")):
        if name.lstrip(".").split(".")[0] in "1234":
            os.remove(os.path.join(progress, "commits", name))
    for name in os.listdir(os.path.join(progress, "offsets")):
        if name.lstrip(".").split(".")[0] in "234":
            os.remove(os.path.join(progress, "offsets", name))
    with pytest.raises(Exception, match="has been merged"):
        run()


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(SAMPLE, encoding="utf-8")
    (source / "b.json").write_text(SAMPLE[:-3], encoding="utf-8")
    annotated = annotate(stream_events(spark, str(source), "document"))
    _run(annotated, str(tmp_path / "out"), str(tmp_path / "progress"))
    kept = read_split(spark, str(tmp_path / "out"), annotated.schema)
    assert sorted(r.status for r in kept.collect()) == ["checked", "malformed"]


# --- Scratch ---


def test_scratch_is_in_the_shared_folder(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert f"/{spark.sparkContext.applicationId}/" in first


def test_scratch_elsewhere(spark, tmp_path):
    class Context:
        applicationId = "app"
        master = "local-cluster[2,1,1024]"
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
    Context.folder = str(tmp_path)
    assert scratch_path(Session(), "x").startswith(f"{tmp_path}/app/x-")


def test_staged_and_discard(spark):
    df, path = staged(spark.range(10), "ten")
    assert df.count() == 10 and os.path.isdir(path)
    discard(spark, path)
    assert not os.path.exists(path)


def test_contract_with_many_names(spark):
    contract = Contract(tuple(f"f{i}" for i in range(120)), "f7", tuple(f"w{i}" for i in range(150)))
    whole = json.dumps({f"f{i}": None for i in range(120)} | {"f7": "w149"})
    rows = annotate(spark.createDataFrame([(whole,), ("{}",)], "v string"), contract).collect()
    assert rows[0].problems == []
    assert rows[1].problems == [*contract.required, "f7"]
