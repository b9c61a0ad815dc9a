"""Which files a run reads: the listing of a folder beside the plan, without opening a file.

A listing has one row per file, from metadata alone. Beside the catalog it tells which sessions
have a file, which have none or an empty one, and which files nobody asked for. Only the files of
planned sessions are then handed to readers, as explicit paths; Spark packs them into tasks by
size, the largest first, and splits those that can be split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SESSION_COLUMNS = ["session_id", "agent", "repo", "fmt"]
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 400  # about what a session takes in a broadcast table


def session_of(path: Column) -> Column:
    """Session key: the file name without its ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, session_id and length of every file below a folder that holds something. The content column of the source is not asked for, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", session_of(F.col("path")).alias("session_id"), "length")


def list_empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of length 0, which Spark's readers leave out: those of the reader's listing that no row names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    alike = lambda path: F.regexp_replace(path, "^([^:/]+:)/+", "$1/").alias("_file")  # noqa: E731  (the listing writes file:///x, rows file:/x)
    every = spark.createDataFrame([(f,) for f in files.inputFiles()], "_file string").select(alike(F.col("_file")))
    return every.join(files.select(alike(F.col("_metadata.file_path"))), "_file", "left_anti").select(
        decoded(F.col("_file")).alias("path"), session_of(decoded(F.col("_file"))).alias("session_id"), F.lit(0).cast("long").alias("length"))


def decoded(path: Column) -> Column:
    """A path of Spark's file metadata as it is written."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _owned(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files with ``own``: whether a file is the one of its session. Of several files of one name it is the one
    at the place that the catalog names, else the first by path."""
    place = F.col("trajectory") if "trajectory" in sessions.columns else F.lit(None).cast("string").alias("trajectory")
    named = files.join(sessions.select("session_id", place), "session_id", "left")
    order = Window.partitionBy("session_id").orderBy((~F.coalesce(F.endswith("path", "trajectory"), F.lit(False))), "path")
    return named.withColumn("own", F.row_number().over(order) == 1).drop("trajectory")


def inventory(sessions: DataFrame, files: DataFrame, plan: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per session of the catalog, per file without one and per requested id that no session has:
    session_id, agent (as the catalog spells it where it is not known), fmt, path, bytes and status:

    ``present``, ``empty`` and ``absent`` (planned sessions by their file), ``not_planned`` (left out by agents, ids or
    limit), ``skipped_agent`` (its agent is not known), ``unplanned_file`` and ``unknown_id``."""
    found = _owned(files, sessions)
    planned = plan.select("session_id", "fmt", F.lit(True).alias("planned"))
    known = sessions.select("session_id", F.coalesce("agent", "agent_raw").alias("agent"), F.col("agent").isNull().alias("skipped")).join(planned, "session_id", "left")
    both = known.withColumn("listed", F.lit(True)).join(found, "session_id", "full_outer")
    stray = F.col("listed").isNull() | ~F.coalesce("own", F.lit(True))
    status = (F.when(stray, "unplanned_file").when(F.col("skipped"), "skipped_agent").when(F.col("planned").isNull(), "not_planned")
              .when(F.col("path").isNull(), "absent").when(F.col("length") == 0, "empty").otherwise("present"))
    out = both.select("session_id", F.when(~stray, F.col("agent")).alias("agent"), F.when(~stray, F.col("fmt")).alias("fmt"), "path", F.col("length").alias("bytes"), status.alias("status"))
    if ids is None:
        return out
    unknown = ids.select("session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    return out.unionByName(unknown.select("session_id", F.lit("unknown_id").alias("status")), allowMissingColumns=True)


def inventory_totals(found: DataFrame) -> DataFrame:
    """Sessions or files and their bytes by status and agent."""
    return found.groupBy("status", "agent").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@dataclass
class PlannedFiles:
    """Files to read, as paths by format and size, and the sessions they belong to."""

    spark: SparkSession
    files: list  # (path, fmt, length), as the reader's own listing has them in the driver
    sessions: DataFrame

    def paths(self, documents: bool, above: int | None = None, upto: int | None = None) -> list[str]:
        """Paths of documents or of line transcripts, by size."""
        return [glob_free(p) for p, fmt, n in self.files if (fmt == "opencode") == documents and (above is None or n > above) and (upto is None or n <= upto)]

    def with_session(self, rows: DataFrame, path: Column) -> DataFrame:
        """Rows with the columns of the session that a path (as Spark's file metadata spells it) belongs to. The sessions are
        broadcast as long as their number shows that they are small."""
        keyed = rows.withColumn("session_id", session_of(decoded(path)))
        small = len(self.files) * ROW_BYTES <= BROADCAST_BYTES
        return keyed.join(F.broadcast(self.sessions) if small else self.sessions, "session_id")


def planned_files(spark: SparkSession, folder: str, plan: DataFrame) -> PlannedFiles:
    """The files of the planned sessions that are there and not empty, largest first."""
    here = _owned(list_files(spark, folder).join(plan.select("session_id"), "session_id", "left_semi"), plan).where("own AND length > 0")
    files = here.join(plan.select("session_id", "fmt"), "session_id").select("path", "fmt", "length").orderBy(F.desc("length"), "path").collect()
    return PlannedFiles(spark, [tuple(f) for f in files], plan.select(*SESSION_COLUMNS))


def glob_free(path: str) -> str:
    """A path in which no sign stands for others."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)
