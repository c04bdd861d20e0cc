"""Streams over the driver's tables, and files that Spark writes and reads line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines
from ..sources.shared import shared_path
from ..streaming.metered import metered, run_metered
from ..streaming.progress import file_stream, latest_counts, live_counts
from .base import query, r6, table


@query("I-4 I-8 (stream)", """WITH r AS (SELECT event_id, event_type, row_number() OVER w - 1 AS call, sum(value) OVER w AS running, value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, event_type, call, round(running, 6) AS running, CASE WHEN running >= 20000 THEN 'stop' WHEN running >= 16000 THEN 'warn' ELSE 'ok' END AS state, round(CASE WHEN call < 25 THEN -1.0 ELSE value / 100 END, 6) AS score FROM r""")
def metered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget, and a warm-up by rule, for each type of event."""
    here, c = shared_path(spark, "metered"), F.col
    stream = file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, 1)
    out = run_metered(spark, metered(stream, "event_type", "event_id", c("value"), c("value") / 100, F.lit(-1.0), c("value") >= 50, 20000.0, first=25), f"{here}/out", f"{here}/checkpoint")
    return out.select("event_id", "event_type", "call", r6(c("running")).alias("running"), "state", r6(c("score")).alias("score"))


@query("I-1 I-2 (stream)", """WITH r AS (SELECT event_id, event_type, value >= 50 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events),
h AS (SELECT event_type, p, row_number() OVER (PARTITION BY event_type ORDER BY p) AS k FROM r WHERE ok), cut AS (SELECT event_type, ceil(p / 48.0) * 48 AS cut FROM h WHERE k = 30)
SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM r LEFT JOIN cut USING (event_type) WHERE cut IS NULL OR p <= cut GROUP BY event_type""")
def gathered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of event until the chunk of its thirtieth success."""
    here, c = shared_path(spark, "gathered"), F.col
    stream = file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, 1)
    out = run_metered(spark, metered(stream, "event_type", "event_id", F.lit(1.0), c("value"), c("value"), c("value") >= 50, 1e18, target=30), f"{here}/out", f"{here}/checkpoint")
    return out.filter("taken").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("I-7", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def live_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor shows after the last batch."""
    here = shared_path(spark, "live")
    stream = file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, 1)
    return latest_counts(spark, live_counts(stream, "event_type"), f"{here}/out", f"{here}/checkpoint")


_TORN = "substring(line, 1, CASE WHEN event_id % 97 = 0 THEN length(line) - 3 ELSE length(line) END)"


def _event_log(spark: SparkSession, sf_dir: str, torn: bool) -> str:
    """Events as JSON lines in a folder, some of them cut short, with blank lines between."""
    path = shared_path(spark, "event-log")
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
    cut = F.expr(_TORN) if torn else F.col("line")
    e.select(F.concat(cut, F.when(F.col("event_id") % 10 == 0, "\n  ").otherwise("")).alias("value")).write.text(path)
    return path


@query("S-2", "SELECT event_type, count(*) FILTER (event_id % 97 <> 0) AS n_rows, round(sum(value) FILTER (event_id % 97 <> 0), 4) AS total, (SELECT count(*) FROM events WHERE event_id % 97 = 0) AS n_torn FROM events GROUP BY event_type")
def torn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with torn lines: what is kept, and how much was dropped."""
    rows, torn = lines.scan(spark, _event_log(spark, sf_dir, True), "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total")).crossJoin(torn.agg(F.count("*").alias("n_torn")))  # one row


@query("S-3", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, count(*) + count(*) FILTER (event_id % 10 = 0) AS n_lines FROM events")
def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without torn lines, read strictly; line numbers count blank lines too."""
    path = _event_log(spark, sf_dir, False)
    rows = lines.scan_strict(spark, path, "event_id long, event_type string, value double")
    last = lines.numbered(spark, path).groupBy("file").agg(F.max("line").alias("n")).agg(F.sum("n").alias("n_lines"))
    return rows.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).crossJoin(last)  # one row each


@query("I-6", "SELECT arg_max(event_id, event_id) FILTER (event_type LIKE 'p%') AS event_id FROM events")
def latest_log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of a kind that a log of all events tells, from the last matching line of each of its files."""
    path = shared_path(spark, "log")
    table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_id", "event_type").alias("value"), "event_id").repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    found = lines.latest_matching(spark, path, r"^\d+ p")
    return found.agg(F.max(F.split("value", " ")[0].cast("long")).alias("event_id"))
