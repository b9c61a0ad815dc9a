"""Session catalog: one JSON document listing every session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, DoubleType

from tollbook.functions.agents import normalize_agent


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_S, _L, _D = StringType(), LongType(), DoubleType()
SESSION = _struct(
    session_id=_S, agent=_S, detected_format=_S, source=_struct(repository=_S), created_at=_S, branch=_S, strategy=_S, bytes=_L,
    trajectory=_S, models=ArrayType(_S), agent_versions=ArrayType(_S), files_touched=ArrayType(_S),
    statistics=_struct(assistant_messages=_L, output_tokens=_L, tool_calls=_L, user_messages=_L),
    checkpoint_token_usage=_struct(api_call_count=_L, output_tokens=_L),
    initial_attribution=_struct(agent_percentage=_D, total_committed=_L),
)
PREFIXES = {"statistics": "stat_", "checkpoint_token_usage": "ckpt_", "initial_attribution": "attr_"}


def scan_catalog(spark: SparkSession, path: str, session: StructType = SESSION) -> DataFrame:
    """One row per session. The nested records are flattened under a prefix; pass a wider
    ``session`` schema to keep more of their fields."""
    doc = spark.read.schema(_struct(sessions=ArrayType(session))).option("multiLine", "true").json(path)
    s = doc.select(F.explode("sessions").alias("s")).select("s.*")
    nested = [
        F.col(f"{outer}.{inner.name}").alias(prefix + inner.name)
        for outer, prefix in PREFIXES.items() for inner in session[outer].dataType.fields
    ]
    key = F.regexp_replace(F.regexp_replace("trajectory", "^.*/", ""), r"\.jsonl$", "")
    return s.select(
        key.alias("session_id"), F.col("session_id").alias("session_id_meta"), normalize_agent(F.col("agent")).alias("agent"),
        F.col("agent").alias("agent_raw"), "detected_format", F.col("source.repository").alias("repo"), "created_at", "branch",
        "strategy", "bytes", "trajectory", F.to_json("models").alias("models"), F.to_json("agent_versions").alias("agent_versions"),
        F.to_json("files_touched").alias("files_touched"),
        F.when(F.col("files_touched").isNull(), 0).otherwise(F.size("files_touched")).cast("long").alias("n_files_touched"), *nested)


def plan_inputs(sessions: DataFrame, agents: list[str] | None = None, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Sessions to read, largest first, with the format their transcript is in."""
    plan = sessions.withColumn("fmt", F.coalesce(normalize_agent(F.col("detected_format")), F.col("agent"))).where("agent IS NOT NULL")
    if agents:
        plan = plan.where(F.col("agent").isin(*agents))
    if ids is not None:
        plan = plan.join(ids.select("session_id").distinct(), "session_id", "left_semi")
    plan = plan.select("session_id", "agent", "repo", "fmt", F.coalesce("bytes", F.lit(0)).alias("bytes"), "trajectory")
    plan = plan.orderBy(F.desc("bytes"), "session_id")
    return plan if limit is None else plan.limit(limit)


def skipped_agents(sessions: DataFrame) -> DataFrame:
    """Sessions of agents that are not known, counted by the name they gave."""
    return sessions.where("agent IS NULL").groupBy("agent_raw").agg(F.count(F.lit(1)).alias("sessions"))


def missing_ids(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("session_id").join(sessions.select("session_id"), "session_id", "left_anti")
