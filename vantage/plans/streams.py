"""What the pipeline does continuously, as batch queries and as Structured Streaming over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.plans.catalog import query
from vantage.streaming import feeds

CAP = 4


@query("rate_limit", f"SELECT event_id, used, used > {CAP} AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, action ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS used FROM kg_actions)")
def rate_limit(v):
    hour = Window.partitionBy("user_id", "action").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return v.actions.select("event_id", F.count("*").over(hour).alias("used")).withColumn("refused", F.col("used") > CAP)


@query("rate_usage", "SELECT user_id, action, count(*) FILTER (ts > (SELECT max(ts) FROM kg_actions) - INTERVAL 24 HOUR) AS used FROM kg_actions GROUP BY user_id, action")
def rate_usage(v):
    now = v.actions.agg(F.max("ts").alias("now"))
    return v.actions.crossJoin(F.broadcast(now)).groupBy("user_id", "action").agg(F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")).alias("used"))  # one row of now


@query("prune_log", "SELECT event_id FROM kg_actions WHERE ts > (SELECT max(ts) FROM kg_actions) - INTERVAL 24 HOUR")
def prune_log(v):
    now = v.actions.agg(F.max("ts").alias("now"))
    return v.actions.crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")).select("event_id")


FEED = "SELECT event_id, user_id, action FROM (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM kg_actions) WHERE before IS DISTINCT FROM action"


@query("run_state_feed", FEED)
def run_state_feed(v):
    before = F.lag("action").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.actions.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("action"))).select("event_id", "user_id", "action")


@query("stall_detect", "SELECT run_id, max(ts) AS last, epoch_us((SELECT max(ts) FROM kg_steps)) - epoch_us(max(ts)) > 360000000 AS stalled FROM kg_steps GROUP BY run_id")
def stall_detect(v):
    now = v.steps.agg(F.max("ts").alias("now"))
    last = v.steps.groupBy("run_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(now)).select("run_id", "last", (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > 360_000_000).alias("stalled"))  # one row of now


@query("step_cache", "SELECT event_id FROM kg_steps s WHERE event_id >= 5000 AND NOT EXISTS (SELECT 1 FROM kg_steps d WHERE d.event_id < 5000 AND NOT d.failed AND d.pos = s.pos AND d.step = s.step AND d.input_hash = s.input_hash)")
def step_cache(v):
    done = v.steps.where("event_id < 5000 AND NOT failed").select("pos", "step", "input_hash")
    return v.steps.where("event_id >= 5000").join(done, ["pos", "step", "input_hash"], "left_anti").select("event_id")


@query("unit_checkpoints", "SELECT DISTINCT run_id, step, input_hash FROM kg_steps")
def unit_checkpoints(v):
    return v.steps.select("run_id", "step", "input_hash").dropDuplicates()


@query("late_reveal", "SELECT id, coalesce(told_pos, shown_pos, 0) AS pos, coalesce(told_pos, shown_pos, 0) - years_ago AS speaks_of FROM kg_scenes WHERE years_ago > 0")
def late_reveal(v):
    at = F.coalesce("told_pos", "shown_pos", F.lit(0))
    return v.scenes.where("years_ago > 0").select("id", at.alias("pos"), (at - F.col("years_ago")).alias("speaks_of"))


@query("ingest_stream", "SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def ingest_stream(v):
    """A file stream of the documents: rows whose fingerprint is already stored are skipped, so a replay adds nothing."""
    return feeds.ingest(v.spark, f"{v.sf_dir}/documents.parquet", v.documents.schema)


#: A cap that the given log reaches: one user seldom acts twice in an hour.
STREAM_CAP = 1


@query("rate_limit_stream", f"""WITH w AS (SELECT user_id, event_type AS action, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS start FROM events, range(6) r(i)),
    c AS (SELECT start, user_id, action, count(*) AS used FROM w GROUP BY start, user_id, action)
    SELECT CAST(epoch(start) AS BIGINT) AS start, user_id, action, used FROM c WHERE used > {STREAM_CAP} AND start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")
def rate_limit_stream(v):
    """Sliding hours of a stream of the log in which a user was over the cap; hours that the watermark has not passed are still open."""
    over = feeds.refused(v.spark, f"{v.sf_dir}/events.parquet", v.events.schema, STREAM_CAP)
    return over.select(F.unix_seconds("start").alias("start"), "user_id", "action", "used")


@query("change_feed_stream", "SELECT user_id, count(*) AS changes FROM (" + FEED + ") GROUP BY user_id")
def change_feed_stream(v):
    """State changes per user by a stateful stream operator; equal to the batch ``lag`` on the same rows."""
    return feeds.changes(v.spark, f"{v.sf_dir}/events.parquet", v.events.schema)
