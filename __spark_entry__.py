"""Registered queries and the SQL that recomputes them.

Every query reads whole tables. Where a record is built with faults, ``event_id`` or
``s_suppkey`` decides which fault a row gets; no row is left out.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge import (
    DEFAULT,
    Contract,
    accepted,
    annotate,
    check,
    check_and_keep,
    gate,
    missing_fields,
    problem_report,
    quarantined,
    read_events,
    read_split,
    stream_events,
    tally,
    vocabulary_check,
    write_split,
    write_split_stream,
)
from recordgauge.plans.scratch import scratch_path

# --- Inputs: one SQL expression each, the same text in Spark and in DuckDB ---------------

USAGE = Contract(
    required=("event_id", "event_type", "ts", "user_id", "props"),
    vocab_field="event_type",
    vocab=("click", "purchase", "signup", "view"),
)
USAGE_RECORD = """
CASE WHEN event_id % 7 = 0 THEN '{"event_id":' || CAST(event_id AS STRING) || ',"user_id":null}'
 WHEN event_id % 11 = 0 THEN '{"event_id":' || CAST(event_id AS STRING) || ',"event_type":"' || upper(event_type) || '","ts":"t","user_id":1,"props":' || props || '}'
 WHEN event_id % 13 = 0 THEN '{}'
 ELSE '{"event_id":' || CAST(event_id AS STRING) || ',"event_type":"' || event_type || '","ts":"t","user_id":' || CAST(user_id AS STRING) || ',"props":' || props || '}' END
"""

# Records for the default contract, from events: whole ones and each way to break the contract.
DEFAULT_PARTS = {
    "f_id": """'"event_id":"e-' || CAST(event_id AS STRING) || '"'""",
    "kind": """CASE event_type WHEN 'click' THEN 'CATALOG_FROZEN' WHEN 'purchase' THEN 'CLAIM_REPLAYED'
  WHEN 'signup' THEN 'DIFF_CLASSIFIED' WHEN 'view' THEN 'MAPPING_REVISED' ELSE 'RELEASE_SIGNED' END""",
    "f_at": """'"occurred_at":"' || CAST(ts AS STRING) || '"'""",
    "f_subject": """'"subject_id":"u-' || CAST(user_id AS STRING) || '"'""",
    "f_payload": """'"payload":' || props""",
}
DEFAULT_RECORD = """
CASE event_id % 19
 WHEN 0 THEN '{' || f_id || ',' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 1 THEN '{' || f_id || ',"kind":null,' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 2 THEN '{' || f_id || ',"kind":' || CAST(event_id AS STRING) || ',' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 3 THEN '{' || f_id || ',"kind":"' || lower(kind) || '",' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 4 THEN '{' || f_id || ',"kind":["' || kind || '"],' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 5 THEN '[{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload || '}]'
 WHEN 6 THEN '{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload
 WHEN 7 THEN '{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload || '} x'
 WHEN 8 THEN '{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload || '}],[{}'
 WHEN 9 THEN '"' || kind || '"'
 WHEN 10 THEN CAST(event_id AS STRING)
 WHEN 11 THEN 'null'
 WHEN 12 THEN '{"payload":{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || '}}'
 WHEN 13 THEN '{"kind":"' || kind || '",' || f_at || '}'
 WHEN 14 THEN '{' || f_id || ',"kind":"' || replace(kind, '_', chr(92) || 'u005f') || '",' || f_at || ',' || f_subject || ',' || f_payload || '}'
 WHEN 15 THEN chr(10) || ' {' || f_id || ', "kind" : "' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload || ', "more":[1,{}]} ' || chr(10)
 ELSE '{' || f_id || ',"kind":"' || kind || '",' || f_at || ',' || f_subject || ',' || f_payload || '}' END
"""

# Multi-line records, one per supplier.
SUPPLIER_RECORD = """
'{' || chr(10) || ' "event_id": "' || s_name || '",' || chr(10)
 || CASE s_nationkey % 6 WHEN 0 THEN ' "kind": "CATALOG_FROZEN",' WHEN 1 THEN ' "kind": "CLAIM_REPLAYED",'
  WHEN 2 THEN ' "kind": "DIFF_CLASSIFIED",' WHEN 3 THEN ' "kind": "MAPPING_REVISED",'
  WHEN 4 THEN ' "kind": "RELEASE_SIGNED",' ELSE ' "kind": "SUPPLIER_LISTED",' END || chr(10)
 || CASE WHEN s_acctbal < 0 THEN '' ELSE ' "subject_id": "' || CAST(s_nationkey AS STRING) || '",' || chr(10) END
 || ' "occurred_at": null,' || chr(10) || ' "payload": {' || chr(10) || '  "note": "x"' || chr(10) || ' }' || chr(10) || '}'
 || CASE WHEN s_suppkey % 10 = 3 THEN chr(10) || '{}' ELSE '' END
"""

# The same as a file's content, one per nation.
NATION_RECORD = """
'{' || chr(10) || ' "event_id": "' || n_name || '",' || chr(10) || ' "kind": "'
 || CASE n_regionkey WHEN 0 THEN 'CATALOG_FROZEN' WHEN 1 THEN 'CLAIM_REPLAYED' WHEN 2 THEN 'NATION_LISTED' ELSE 'RELEASE_SIGNED' END || '",' || chr(10)
 || CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE ' "subject_id": ' || CAST(n_nationkey AS STRING) || ',' || chr(10) END
 || ' "occurred_at": null,' || chr(10) || ' "payload": {"note": "x"}' || chr(10) || '}' || chr(10)
 || CASE WHEN n_nationkey % 10 = 3 THEN '{}' ELSE '' END
"""

# Every event as a record that keeps the default contract.
CONFORMING_RECORD = """
'{"event_id":' || CAST(event_id AS STRING) || ',"kind":"'
 || CASE event_type WHEN 'click' THEN 'CATALOG_FROZEN' WHEN 'purchase' THEN 'CLAIM_REPLAYED' ELSE 'RELEASE_SIGNED' END
 || '","occurred_at":"' || CAST(ts AS STRING) || '","subject_id":' || CAST(user_id AS STRING) || ',"payload":' || props || '}'
"""

# Valid records of which some are deeper, or have a longer name, than the parser takes, and some
# have numbers longer than it takes at once.
LIMIT_RECORD = """
'{"event_id":1,"occurred_at":null,"subject_id":0,"kind":"RELEASE_SIGNED","payload":'
 || CASE WHEN event_id % 500 = 0 THEN '{"' || repeat('n', 60000) || '":1}'
  WHEN event_id % 50 = 1 THEN repeat('[', 1500) || repeat(']', 1500)
  WHEN event_id % 50 = 2 THEN repeat('[', 400) || repeat(']', 400)
  WHEN event_id % 50 = 3 THEN '-' || repeat('7', 2500) || '.' || repeat('0', 1200)
  WHEN event_id % 50 = 4 THEN '0' || repeat('7', 2500)
  ELSE props END || '}'
"""

# Records with a name twice, of which the last counts.
REPEATED_RECORD = """
'{"kind":"' || CASE event_id % 4 WHEN 0 THEN 'CATALOG_FROZEN' WHEN 1 THEN 'UNHEARD_OF' WHEN 2 THEN 'CLAIM_REPLAYED' ELSE 'NONE' END
 || '","event_id":1,"event_id":2,"occurred_at":1,"subject_id":1,"payload":{"a":1,"a":2},"kind":"'
 || CASE event_id % 4 WHEN 0 THEN 'CLAIM_REPLAYED' WHEN 1 THEN 'CATALOG_FROZEN' WHEN 2 THEN 'UNHEARD_OF' ELSE 'NOTHING' END
 || CASE event_id % 5 WHEN 0 THEN '","n":' || repeat('1', 2000) || '}' ELSE '"}' END
"""

WIDE = Contract(required=tuple(f"field_{i}" for i in range(40)), vocab_field="field_7", vocab=("known",))
WIDE_RECORD = "'{' || " + " || ".join(
    f"""CASE WHEN event_id % {i + 2} = 1 THEN '' ELSE '"field_{i}":{'"known"' if i == 7 else i},' END""" for i in range(40)
) + """ || '"last":0}'"""

ARTICLE = Contract(
    required=("doc_id", "lang", "source", "text", "quality"),
    vocab_field="lang",
    vocab=("de", "en", "fr"),
)
MESSAGE = Contract(
    required=("conv_id", "turn", "role", "text"), vocab_field="role", vocab=("assistant", "user")
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.expr(USAGE_RECORD).alias("v"))


def _default_of(events: DataFrame) -> DataFrame:
    parts = events.select("event_id", *(F.expr(e).alias(n) for n, e in DEFAULT_PARTS.items()))
    return parts.select("event_id", F.expr(DEFAULT_RECORD).alias("v"))


def _of_events(spark: SparkSession, sf_dir: str, record: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.expr(record).alias("v"))


def _default_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _default_of(_table(spark, sf_dir, "events"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # to_json leaves out a NULL field, so an unlabelled document has no "quality".
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        _table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "text", "quality")).alias("v"))
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("v")
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Free text, hardly ever JSON: everything has to come out as malformed, not as an error.
    def part(name: str, column: str) -> DataFrame:
        return _table(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(column).alias("v"))

    return (
        part("documents", "text")
        .unionAll(part("pages", "html"))
        .unionAll(part("conversations", "text"))
        .unionAll(part("benchmark", "text"))
        .unionAll(part("events", "props"))
    )


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "status", F.array_join("problems", ",").alias("problems"), "valid")


# --- Queries -------------------------------------------------------------------------------


def missing_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_fields(_default_records(spark, sf_dir)).select(
        "event_id", F.array_join("missing", ",").alias("missing")
    )


def vocabulary_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_check(_default_records(spark, sf_dir)).select("event_id", "unknown_word")


def annotate_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(annotate(_default_records(spark, sf_dir)), "event_id")


def annotate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(annotate(_usage(spark, sf_dir), USAGE), "event_id")


def annotate_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(annotate(_articles(spark, sf_dir), ARTICLE), "doc_id")


def accepted_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(annotate(_default_records(spark, sf_dir))).select("event_id")


def quarantined_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quarantined(annotate(_default_records(spark, sf_dir))), "event_id")


def accepted_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(annotate(_usage(spark, sf_dir), USAGE)).select("event_id")


def quarantined_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quarantined(annotate(_usage(spark, sf_dir), USAGE)), "event_id")


def gate_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(annotate(_default_records(spark, sf_dir)))


def gate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(annotate(_usage(spark, sf_dir), USAGE))


def gate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(annotate(_messages(spark, sf_dir), MESSAGE))


def report_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problem_report(annotate(_default_records(spark, sf_dir)))


def report_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problem_report(annotate(_usage(spark, sf_dir), USAGE), USAGE)


def report_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problem_report(annotate(_articles(spark, sf_dir), ARTICLE), ARTICLE)


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's counts and the report's, both from one pass over the records."""
    outcome = check(_default_records(spark, sf_dir))
    counts = [c for c in outcome.gate.columns if c.startswith("n_")]
    gate_rows = outcome.gate.unpivot([], counts, "name", "n").select(F.lit("gate").alias("part"), "name", "n")
    report_rows = outcome.report.select(
        F.lit("report").alias("part"), F.col("problem").alias("name"), F.col("n_records").alias("n")
    )
    return gate_rows.unionAll(report_rows)


def raw_text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        annotate(_texts(spark, sf_dir))
        .groupBy("origin", "status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("v")).alias("n_chars"))
    )


def split_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "split")
    annotated = annotate(_default_records(spark, sf_dir))
    write_split(annotated, path)
    kept = read_split(spark, path, annotated.schema)
    return (
        _shown(accepted(kept), "event_id")
        .withColumn("side", F.lit("accepted"))
        .unionAll(_shown(quarantined(kept), "event_id").withColumn("side", F.lit("quarantined")))
    )


def gate_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_and_keep(_usage(spark, sf_dir), scratch_path(spark, "kept"), USAGE)[1].gate


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(annotate(read_events(spark, _usage_lines(spark, sf_dir)), USAGE))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per nation: the table has 25 rows at every scale."""
    path = scratch_path(spark, "documents")
    records = _table(spark, sf_dir, "nation").select("n_nationkey", F.expr(NATION_RECORD).alias("v"))
    records.write.partitionBy("n_nationkey").text(path)
    read = read_events(spark, path, "document")
    return _shown(annotate(read), "n_nationkey").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))


def annotate_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SUPPLIER_RECORD).alias("v"))
    return _shown(annotate(records), "s_suppkey")


def annotate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(annotate(_of_events(spark, sf_dir, LIMIT_RECORD)), "event_id")


def annotate_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(annotate(_of_events(spark, sf_dir, REPEATED_RECORD)), "event_id")


def gate_conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(annotate(_of_events(spark, sf_dir, CONFORMING_RECORD)))


def gate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(annotate(_of_events(spark, sf_dir, LIMIT_RECORD)))


def report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that each lack other names of a contract of forty."""
    return problem_report(annotate(_of_events(spark, sf_dir, WIDE_RECORD), WIDE), WIDE)


def stream_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of parquet files, annotated into the parted sink."""
    schema = _table(spark, sf_dir, "events").schema
    # A pattern, since a stream source refuses the path of a single file.
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return _shown(_drained(spark, annotate(_default_of(arriving))), "event_id")


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of JSON lines as a stream, annotated into the parted sink."""
    arriving = stream_events(spark, _usage_lines(spark, sf_dir))
    return _verdicts(_drained(spark, annotate(arriving, USAGE)))


def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a file to a batch, with closed batches merged as the stream goes on."""
    path = scratch_path(spark, "lines")
    _usage(spark, sf_dir).select("v").repartition(8).write.text(path)
    arriving = stream_events(spark, path, max_files_per_trigger=1)
    return _verdicts(_drained(spark, annotate(arriving, USAGE), fan_in=3))


def _usage_lines(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "lines")
    _usage(spark, sf_dir).select("v").write.text(path)
    return path


def _drained(spark: SparkSession, annotated: DataFrame, fan_in: int | None = None) -> DataFrame:
    path = scratch_path(spark, "stream")
    query = write_split_stream(annotated, path, scratch_path(spark, "progress"), available_now=True, fan_in=fan_in)
    query.awaitTermination()
    return read_split(spark, path, annotated.schema)


def _verdicts(annotated: DataFrame) -> DataFrame:
    return _shown(tally(annotated), "n")


def entry(spark: SparkSession) -> DataFrame:
    """The problem report over the default contract's records."""
    return report_default(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        missing_default,
        vocabulary_default,
        annotate_default,
        annotate_usage,
        annotate_articles,
        accepted_default,
        quarantined_default,
        accepted_usage,
        quarantined_usage,
        gate_default,
        gate_usage,
        gate_messages,
        report_default,
        report_usage,
        report_articles,
        check_summary,
        raw_text_status,
        annotate_suppliers,
        annotate_limits,
        annotate_repeated_names,
        gate_conforming,
        gate_limits,
        report_wide,
        split_written,
        gate_written,
        read_lines,
        read_documents,
        stream_annotate,
        stream_lines,
        stream_compacted,
    )
    found = {query.__name__: query for query in listed}
    corpus, pipeline = _optional("recordgauge.llm.queries"), _optional("corpus_pipeline")
    if corpus:
        found |= corpus.queries()
    if pipeline:
        found["pipeline"] = pipeline.run
    return found


def _optional(name: str) -> ModuleType | None:
    """A module of the corpus operators, or None if they are not installed.

    Only the absence of these modules themselves is passed over, not an error inside them.
    """
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name in ("recordgauge.llm", name):
            return None
        raise


# --- The same results in SQL ---------------------------------------------------------------


def _quoted(texts: tuple[str, ...]) -> str:
    return "[" + ",".join(f"'{t}'" for t in texts) + "]"


def _annotated_sql(records: str, contract: Contract, keys: str) -> str:
    """``a(keys, status, missing, bad_word, problems, valid)`` over ``records(keys, v)``."""
    required, vocab, field = _quoted(contract.required), _quoted(contract.vocab), contract.vocab_field
    return f"""
WITH r AS ({records}),
j AS (SELECT *, CASE WHEN json_valid(v) THEN v END AS j FROM r),
s AS (SELECT *, CASE WHEN j IS NULL THEN 'malformed'
   WHEN json_type(j) IN ('OBJECT', 'ARRAY') THEN 'checked' ELSE 'not_object' END AS status FROM j),
k AS (SELECT {keys}, v, status,
  CASE WHEN status = 'checked' THEN CASE WHEN json_type(j) = 'OBJECT'
   THEN list_filter({required}, lambda x: NOT list_contains(json_keys(j), x)) ELSE {required} END END AS missing,
  CASE WHEN status = 'checked' THEN NOT coalesce(json_type(j, '$.{field}') = 'VARCHAR'
   AND list_contains({vocab}, json_extract_string(j, '$.{field}')), false) END AS bad_word FROM s),
a AS (SELECT {keys}, v, status, missing, bad_word,
  CASE WHEN status = 'checked' THEN list_concat(missing, CASE WHEN bad_word THEN ['{field}'] ELSE [] END) END AS problems,
  CASE WHEN status = 'checked' THEN len(missing) = 0 AND NOT bad_word END AS valid FROM k)
"""


_SHOWN = "status, array_to_string(problems, ',') AS problems, valid"
_GATE = """
SELECT count(*) AS n_records, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid,
 count(*) FILTER (WHERE status = 'not_object') AS n_not_object, count(*) FILTER (WHERE status = 'malformed') AS n_malformed,
 count(*) FILTER (WHERE valid) = count(*) AS conforms FROM a
"""
_OCCURRENCES = """
, o AS (SELECT a.v AS v, u.problem AS problem, count(*) AS n FROM
 (SELECT row_number() OVER () AS v, problems FROM a) a, unnest(a.problems) AS u(problem) GROUP BY ALL)
"""
_REPORT = "SELECT problem, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_occurrences FROM o GROUP BY problem"
_VERDICTS = f"SELECT count(*) AS n, {_SHOWN} FROM a GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    parts = ", ".join(f"{e} AS {n}" for n, e in DEFAULT_PARTS.items())
    default = _annotated_sql(
        f"SELECT event_id, {DEFAULT_RECORD} AS v FROM (SELECT event_id, {parts} FROM events)",
        DEFAULT,
        "event_id",
    )
    usage = _annotated_sql(f"SELECT event_id, {USAGE_RECORD} AS v FROM events", USAGE, "event_id")
    articles = _annotated_sql(
        """SELECT d.doc_id, '{"doc_id":' || d.doc_id || ',"lang":' || to_json(d.lang) || ',"source":' || to_json(d.source)
 || ',"text":' || to_json(d.text) || CASE WHEN l.quality IS NULL THEN '' ELSE ',"quality":' || l.quality END || '}' AS v
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        ARTICLE,
        "doc_id",
    )
    messages = _annotated_sql(
        "SELECT conv_id, turn, CAST(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}) AS VARCHAR) AS v"
        " FROM conversations",
        MESSAGE,
        "conv_id, turn",
    )
    suppliers = _annotated_sql(f"SELECT s_suppkey, {SUPPLIER_RECORD} AS v FROM supplier", DEFAULT, "s_suppkey")
    nations = _annotated_sql(
        f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {NATION_RECORD} AS v FROM nation", DEFAULT, "n_nationkey"
    )
    # From how the rows are built: DuckDB has limits of its own and keeps the first of equal names.
    limits = """WITH a AS (SELECT *, CASE WHEN status = 'checked' THEN [] END AS problems,
  CASE WHEN status = 'checked' THEN true END AS valid FROM (SELECT event_id, CASE
  WHEN event_id % 500 <> 0 AND event_id % 50 = 4 THEN 'malformed' ELSE 'checked' END AS status FROM events))"""
    repeated = """WITH a AS (SELECT event_id, 'checked' AS status, CASE WHEN event_id % 4 < 2 THEN [] ELSE ['kind'] END AS problems,
  event_id % 4 < 2 AS valid FROM events)"""
    texts = _annotated_sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS origin, {column} AS v FROM {name}"
            for name, column in (
                ("documents", "text"),
                ("pages", "html"),
                ("conversations", "text"),
                ("benchmark", "text"),
                ("events", "props"),
            )
        ),
        DEFAULT,
        "origin",
    )
    found = {
        "missing_default": f"{default} SELECT event_id, array_to_string(missing, ',') AS missing FROM a",
        "vocabulary_default": f"{default} SELECT event_id, bad_word AS unknown_word FROM a",
        "annotate_default": f"{default} SELECT event_id, {_SHOWN} FROM a",
        "annotate_usage": f"{usage} SELECT event_id, {_SHOWN} FROM a",
        "annotate_articles": f"{articles} SELECT doc_id, {_SHOWN} FROM a",
        "accepted_default": f"{default} SELECT event_id FROM a WHERE valid",
        "quarantined_default": f"{default} SELECT event_id, {_SHOWN} FROM a WHERE valid IS NOT TRUE",
        "accepted_usage": f"{usage} SELECT event_id FROM a WHERE valid",
        "quarantined_usage": f"{usage} SELECT event_id, {_SHOWN} FROM a WHERE valid IS NOT TRUE",
        "gate_default": default + _GATE,
        "gate_usage": usage + _GATE,
        "gate_messages": messages + _GATE,
        "report_default": default + _OCCURRENCES + _REPORT,
        "report_usage": usage + _OCCURRENCES + _REPORT,
        "report_articles": articles + _OCCURRENCES + _REPORT,
        "check_summary": f"""{default} {_OCCURRENCES}, p AS ({_REPORT}), g AS ({_GATE})
SELECT 'report' AS part, problem AS name, n_records AS n FROM p
UNION ALL SELECT 'gate' AS part, name, n FROM
 (UNPIVOT g ON n_records, n_valid, n_invalid, n_not_object, n_malformed INTO NAME name VALUE n)""",
        "raw_text_status": f"""{texts} SELECT origin, status, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS n_chars
FROM a GROUP BY origin, status""",
        "split_written": f"""{default} SELECT event_id, {_SHOWN},
 CASE WHEN valid THEN 'accepted' ELSE 'quarantined' END AS side FROM a""",
        "gate_written": usage + _GATE,
        "read_lines": usage + _VERDICTS,
        "read_documents": f"{nations} SELECT n_nationkey, {_SHOWN} FROM a",
        "annotate_suppliers": f"{suppliers} SELECT s_suppkey, {_SHOWN} FROM a",
        "annotate_limits": f"{limits} SELECT event_id, {_SHOWN} FROM a",
        "annotate_repeated_names": f"{repeated} SELECT event_id, {_SHOWN} FROM a",
        "gate_conforming": _annotated_sql(f"SELECT event_id, {CONFORMING_RECORD} AS v FROM events", DEFAULT, "event_id")
        + _GATE,
        "gate_limits": limits + _GATE,
        "report_wide": _annotated_sql(f"SELECT event_id, {WIDE_RECORD} AS v FROM events", WIDE, "event_id")
        + _OCCURRENCES
        + _REPORT,
        "stream_annotate": f"{default} SELECT event_id, {_SHOWN} FROM a",
        "stream_lines": usage + _VERDICTS,
        "stream_compacted": usage + _VERDICTS,
    }
    corpus, pipeline = _optional("recordgauge.llm.queries"), _optional("corpus_pipeline")
    if corpus:
        found |= corpus.oracle_sql()
    if pipeline and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found
