"""Costs, queues and health of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import horizon as hz
from vantage.plans.catalog import query

D = "CAST(sum(CAST(cost AS DECIMAL(14, 6))) AS DOUBLE)"


def money(c="cost"):
    return F.sum(F.col(c).cast("decimal(14,6)")).cast("double")


@query("cost_by_step", f"SELECT step, count(DISTINCT run_id) AS runs, {D} AS cost, max(attempt) AS attempts, count(*) FILTER (failed) AS failures FROM kg_steps GROUP BY step")
def cost_by_step(v):
    return v.steps.groupBy("step").agg(F.count_distinct("run_id").alias("runs"), money().alias("cost"), F.max("attempt").alias("attempts"), F.count_if("failed").alias("failures"))


@query("cost_by_position", f"SELECT pos, count(DISTINCT run_id) AS runs, {D} AS cost, round({D} / count(DISTINCT run_id), 6) AS mean_cost FROM kg_steps GROUP BY pos")
def cost_by_position(v):
    return v.steps.groupBy("pos").agg(F.count_distinct("run_id").alias("runs"), money().alias("cost"), F.round(money() / F.count_distinct("run_id"), 6).alias("mean_cost"))


@query("cost_summary", f"SELECT {D} AS total, round({D} / count(DISTINCT pos), 6) AS per_position, round(count(*) FILTER (NOT failed) / count(*), 6) AS success_rate FROM kg_steps")
def cost_summary(v):
    return v.steps.agg(money().alias("total"), F.round(F.try_divide(money(), F.count_distinct("pos")), 6).alias("per_position"), F.round(F.try_divide(F.count_if(~F.col("failed")), F.count("*")), 6).alias("success_rate"))


@query("quarantine_health", "SELECT category AS reason, count(*) AS n, max(seq) AS last_seen FROM kg_proposals WHERE status = 'rejected' GROUP BY category")
def quarantine_health(v):
    return v.proposals.where("status = 'rejected'").groupBy(F.col("category").alias("reason")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seen"))


@query("failure_health", "SELECT pos, count(*) AS failures, arg_max(event_id, (ts, event_id)) AS last_error FROM kg_steps WHERE failed GROUP BY pos")
def failure_health(v):
    return v.steps.where("failed").groupBy("pos").agg(F.count("*").alias("failures"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_error"))


@query("queue_counts", "SELECT count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (run_id <> 'run3') AS other_runs, count(*) FILTER (predicate = 'same_as') AS explicit_review FROM kg_proposals")
def queue_counts(v):
    n = lambda c: F.count_if(F.expr(c))
    return v.proposals.agg(n("status = 'proposed'").alias("proposed"), n("status = 'accepted'").alias("accepted"), n("status = 'rejected'").alias("rejected"), n("run_id <> 'run3'").alias("other_runs"), n("predicate = 'same_as'").alias("explicit_review"))


@query("review_queue", """WITH q AS (SELECT *, CASE category WHEN 'entity' THEN 3 WHEN 'assertion' THEN 2 ELSE 1 END AS priority FROM kg_proposals WHERE status = 'proposed'), t AS (SELECT * FROM q ORDER BY priority DESC, confidence, id LIMIT 100),
    b AS (SELECT entity_id, label FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY precedence DESC, revealed_pos DESC, label) AS r FROM kg_names WHERE revealed_pos <= $h) WHERE r = 1)
    SELECT t.id, t.priority, t.confidence, coalesce(b.label, '?') AS name, e.node_type FROM t LEFT JOIN b ON b.entity_id = t.subject LEFT JOIN kg_entities e ON e.id = t.subject""")
def review_queue(v):
    rank = F.when(F.col("category") == "entity", 3).when(F.col("category") == "assertion", 2).otherwise(1)
    top = v.proposals.where("status = 'proposed'").withColumn("priority", rank).orderBy(F.desc("priority"), "confidence", "id").limit(100)
    names = hz.best_label(v.names, 40).select(F.col("entity_id").alias("subject"), "label")
    types = v.entities.select(F.col("id").alias("subject"), "node_type")
    return top.join(names, "subject", "left").join(types, "subject", "left").select("id", "priority", "confidence", F.coalesce("label", F.lit("?")).alias("name"), "node_type")


@query("resolve_local_ids", "SELECT run_id, local_id, CASE WHEN count(DISTINCT subject) = 1 THEN min(subject) END AS entity_id FROM kg_proposals WHERE category = 'entity' GROUP BY run_id, local_id")
def resolve_local_ids(v):
    return v.proposals.where("category = 'entity'").groupBy("run_id", "local_id").agg(F.when(F.count_distinct("subject") == 1, F.min("subject")).alias("entity_id"))


@query("list_positions", "SELECT p.pos, p.status, coalesce(bool_or(s.id IS NOT NULL), false) AS has_text, count(DISTINCT s.id) AS passages FROM kg_positions p LEFT JOIN kg_scenes s ON coalesce(s.told_pos, s.shown_pos, 0) = p.pos GROUP BY p.pos, p.status")
def list_positions(v):
    text = v.scenes.groupBy(F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("pos")).agg(F.count_distinct("id").alias("passages"))
    return v.positions.join(text, "pos", "left").select("pos", "status", F.col("passages").isNotNull().alias("has_text"), F.coalesce("passages", F.lit(0)).alias("passages"))


@query("passages_per_page", "SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS passages FROM pages")
def passages_per_page(v):
    return v.pages.select("page_id", F.regexp_count("html", F.lit("<p[ >]")).alias("passages"))


@query("batch_status", """SELECT count(*) FILTER (n = 0) AS queued, count(*) FILTER (n > 0 AND failures > 0) AS failed, count(*) FILTER (n > 0 AND failures = 0) AS clean, min(pos) FILTER (failures > 0) AS first_blocked
    FROM (SELECT p.pos, count(s.event_id) AS n, count(*) FILTER (s.failed) AS failures FROM kg_positions p LEFT JOIN kg_steps s ON s.pos = p.pos GROUP BY p.pos)""")
def batch_status(v):
    done = v.steps.groupBy("pos").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
    state = v.positions.select("pos").join(done, "pos", "left").na.fill(0)
    return state.agg(F.count_if(F.col("n") == 0).alias("queued"), F.count_if((F.col("n") > 0) & (F.col("failures") > 0)).alias("failed"), F.count_if((F.col("n") > 0) & (F.col("failures") == 0)).alias("clean"), F.min(F.when(F.col("failures") > 0, F.col("pos"))).alias("first_blocked"))


@query("run_view", "SELECT run_id, step, max(attempt) AS attempt, arg_max(failed, attempt) AS failed, count(*) FILTER (NOT failed) AS units_done FROM kg_steps GROUP BY run_id, step")
def run_view(v):
    return v.steps.groupBy("run_id", "step").agg(F.max("attempt").alias("attempt"), F.max_by("failed", "attempt").alias("failed"), F.count_if(~F.col("failed")).alias("units_done"))


@query("latest_run", "SELECT pos, run_id FROM (SELECT pos, run_id, row_number() OVER (PARTITION BY pos ORDER BY ts DESC, event_id DESC) AS r FROM kg_steps) WHERE r = 1")
def latest_run(v):
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("ts"), F.desc("event_id")))
    return v.steps.select("pos", "run_id", rank.alias("r")).where("r = 1").drop("r")


@query("position_costs", f"SELECT run_id, {D} AS cost FROM kg_steps WHERE pos = 7 GROUP BY run_id")
def position_costs(v):
    return v.steps.where("pos = 7").groupBy("run_id").agg(money().alias("cost"))
