"""Progress history, state machines and event-time windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions.text import quarantine_seconds
from quillframe.operators import planning, state
from quillframe.plans.book import Book
from quillframe.sources.shared import new_folder
from quillframe.sources.tables import table
from quillframe.streaming import folds, streams
from quillframe.streaming.upsert import UpsertTable

book = Book()
ORDER = ["signup", "view", "click", "purchase"]


@book.query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def progress_history(spark, sf_dir):
    return streams.history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "event_type")


@book.query("""
SELECT user_id, event_type AS status, coalesce(list_position(['signup', 'view', 'click', 'purchase'], event_type) >= 3, false) AS reached
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def stage_state(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return last.select("user_id", "status", state.at_or_after(F.col("status"), F.lit("click"), ORDER).alias("reached"))


_FAILURES_SQL = """(SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS failures
  FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events))"""


@book.query(f"SELECT user_id, event_id, failures::INT AS failures, event_type = 'error' AND failures >= 3 AS locks FROM {_FAILURES_SQL}")
def lockout_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "signup").alias("succeeded"))
    return folds.lockout(events, "user_id", ["ts", "event_id"], threshold=3).select("user_id", "event_id", "failures", "locks")


@book.query("""
WITH r AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY ts, event_id) AS n FROM r)
SELECT user_id, event_id, (CASE WHEN event_type <> 'error' THEN 0 ELSE CASE event_id % 4 WHEN 0 THEN 300 WHEN 1 THEN 30 ELSE CASE WHEN n >= 3 THEN 60 ELSE 0 END END * least(n, 10) END)::INT AS seconds FROM f""")
def quarantine_secs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = events.withColumn("g", F.count_if(F.col("event_type") != "error").over(order)).withColumn("bad", F.col("event_type") == "error")
    n = F.row_number().over(Window.partitionBy("user_id", "g", "bad").orderBy("ts", "event_id"))
    status = F.when(F.col("event_id") % 4 == 0, 401).when(F.col("event_id") % 4 == 1, 429).otherwise(500)
    return runs.select("user_id", "event_id", F.when(F.col("bad"), quarantine_seconds(status, n)).otherwise(0).cast("int").alias("seconds"))


@book.query("SELECT user_id, least(5 + count(DISTINCT event_type), 8)::BIGINT AS shown FROM events GROUP BY user_id")
def optimistic_progress(spark, sf_dir):
    touched = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return touched.select("user_id", state.progress(F.lit(5), F.col("n"), F.lit(8)).alias("shown"))


@book.query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return streams.tumbling(streams.read_events(spark, sf_dir), "1 hour")


@book.query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return streams.sessions(streams.read_events(spark, sf_dir), "6 hours")


@book.query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS earlier FROM events")
def earlier_event(spark, sf_dir):
    """The event before of the same user, by time."""
    return planning.latest_before(table(spark, sf_dir, "events"), "user_id", "ts", "earlier", value="event_id").select("event_id", "earlier")


_SLOT_SQL = """(SELECT user_id, event_id, ts, event_type <> 'error' AS ok, CASE event_id % 4 WHEN 0 THEN 401 WHEN 1 THEN 429 ELSE 500 END AS status FROM events)"""


@book.query(f"""
WITH m AS (SELECT *, ok OR coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, false) AS new FROM {_SLOT_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m),
f AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r),
s AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN status = 401 THEN 300 WHEN status = 429 THEN 30 WHEN failures >= 3 THEN 60 ELSE 0 END * least(failures, 10) ELSE 0 END AS secs FROM f)
SELECT user_id, event_id, failures::INT AS failures, last_value(CASE WHEN secs > 0 THEN (ts + to_seconds(secs))::TIMESTAMP END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS blocked_until FROM s""")
def quarantine_state(spark, sf_dir):
    """Slots at rest, as a stream with timers; event times are naive."""
    status = F.when(F.col("event_id") % 4 == 0, 401).when(F.col("event_id") % 4 == 1, 429).otherwise(500)
    events = streams.read_events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"), status.alias("status"))
    found = streams.drained(folds.quarantine_stream(events, "user_id"), "append", timers=True)
    return found.withColumn("blocked_until", F.col("blocked_until").cast("timestamp_ntz"))


@book.query(f"""
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS title, o_orderpriority AS status, o_orderkey % 3 AS n FROM orders WHERE o_orderkey % 3 <> 2
  UNION ALL SELECT o_orderkey, 'late ' || o_orderstatus, 'late', 2 FROM orders WHERE o_orderkey % 2 = 0)
SELECT k AS source_id, arg_max(title, n) AS title, arg_min(status, n) AS status FROM b GROUP BY k""")
def upsert_stream(spark, sf_dir):
    """Three batches into a table, the last of them twice, once after a restart without a checkpoint."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("status"))
    late = orders.where("source_id % 2 = 0").select("source_id", F.concat(F.lit("late "), "title").alias("title"), F.lit("late").alias("status"))
    feed, checkpoint = new_folder(spark, "feed"), new_folder(spark, "feed-state")
    stored = UpsertTable(new_folder(spark, "upserts"), ["source_id"], ["title"], ["status"])
    for batch in (orders.where("source_id % 3 = 0"), orders.where("source_id % 3 = 1"), late):
        batch.write.mode("append").parquet(feed)
        stored.sink(spark.readStream.schema(orders.schema).parquet(feed), checkpoint)
    stored.apply(late.withColumn("title", F.lit("never seen")), 2)
    return stored.read(spark, orders.schema)


@book.query("""
SELECT user_id, list_reduce(list_prepend('', list(event_type ORDER BY ts, event_id)), lambda now, s:
  CASE WHEN s = 'error' OR now IN ('', 'error') OR list_position(['signup', 'view', 'click', 'purchase'], s) >= list_position(['signup', 'view', 'click', 'purchase'], now) THEN s ELSE now END) AS status
FROM events GROUP BY user_id""")
def stage_machine(spark, sf_dir):
    """The status of each user as a stream: only a later stage moves it, an error always does, and anything leaves an error."""
    events = streams.read_events(spark, sf_dir).select("user_id", "ts", F.col("event_type").alias("status"))
    return streams.drained(folds.last_status_stream(events, "user_id", ORDER), "update")
