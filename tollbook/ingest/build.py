"""Transcripts of all harnesses -> one ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbook.ingest import claude_code, codex, cursor, opencode
from tollbook.ingest.common import Parts, in_ledger_shape
from tollbook.schemas import LEDGER, conform
from tollbook.session import configure, fresh_folder
from tollbook.sources.catalog import plan_inputs, scan_catalog
from tollbook.sources.ledger import Ledger
from tollbook.sources.inventory import planned_files
from tollbook.sources.transcripts import DOCUMENT_BYTES, parsed_lines, scan_jsonl, scan_messages, split_errors

LINE_PARSERS = {"claude_code": claude_code.parse, "codex": codex.parse, "cursor": cursor.parse}
FACTS = ["calls", "tool_calls", "user_turns", "events"]


def parse_lines(records: DataFrame) -> list[Parts]:
    """Ledger parts of line-based records; each harness reads its own format."""
    return [parse(records.where(F.col("fmt") == fmt)) for fmt, parse in LINE_PARSERS.items()]


def gather(parts: list[Parts], sessions: DataFrame) -> Ledger:
    return gather_facts([in_ledger_shape(p) for p in parts], sessions)


def gather_facts(shaped: list[Parts], sessions: DataFrame) -> Ledger:
    facts = {name: reduce(DataFrame.unionByName, [getattr(p, name) for p in shaped]) for name in FACTS}
    return Ledger(**facts, sessions=conform(sessions, LEDGER["sessions"], keep_extra=True))


def _staged(df: DataFrame, label: str) -> DataFrame:
    """Numbered and parsed rows as a compressed table in the shared folder, one part per
    format: the text is read, numbered and parsed once, however many tables are drawn from it."""
    path = fresh_folder(df.sparkSession, label)
    df.write.partitionBy("fmt").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_ledger(spark: SparkSession, catalog: str, transcripts: str, agents: list[str] | None = None,
                 ids: DataFrame | None = None, limit: int | None = None, whole_bytes: int = DOCUMENT_BYTES) -> tuple[Ledger, DataFrame]:
    """(ledger, errors) of a catalog file and a folder of transcripts. Documents of more than ``whole_bytes`` are read by several tasks."""
    configure(spark)
    sessions = scan_catalog(spark, catalog)
    plan = plan_inputs(sessions, agents, ids, limit)
    files = planned_files(spark, transcripts, plan)
    records, bad_lines = split_errors(_staged(parsed_lines(scan_jsonl(spark, transcripts, plan, files)), "records"))
    messages, bad_documents = scan_messages(spark, transcripts, plan, files, whole_bytes)
    ledger = gather([*parse_lines(records), opencode.parse(messages)], sessions)
    return ledger, bad_lines.unionByName(bad_documents)


def ingest_totals(ledger: Ledger, errors: DataFrame) -> DataFrame:
    """Rows and bad lines per agent."""
    counts = [
        getattr(ledger, name).groupBy("agent").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name)) for name in [*FACTS, "sessions"]
    ]
    owner = ledger.sessions.select("session_id", "agent")
    counts.append(errors.join(owner, "session_id", "left").groupBy("agent").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("bad_lines")))
    names = [*FACTS, "sessions", "bad_lines"]
    return reduce(DataFrame.unionByName, counts).groupBy("agent").pivot("what", names).agg(F.sum("n")).na.fill(0, names).orderBy("agent")
