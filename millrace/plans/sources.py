"""Readers, writers and streams on the test tables: every query writes a table of the given rows and reads it back."""

from pyspark.sql import functions as F

from millrace.operators import quality as Q
from millrace.plans.registry import query
from millrace.session import work_folder
from millrace.sources import files as S
from millrace.streaming import streams as R

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("csv_scan", ORDERS)
def csv_scan(t):
    path = work_folder(t.spark, "csv")
    S.write_rows(t.orders.select(*COLS), path, "csv")
    text = S.read_csv_text(t.spark, path, COLS)
    return S.typed(text, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"})


@query("csv_json_sink", ORDERS)
def csv_json_sink(t):
    path = work_folder(t.spark, "json")
    S.write_rows(t.orders.select(*COLS), path, "json")
    return t.spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").json(path)


@query("json_scan", "SELECT event_id, event_type, value FROM events")
def json_scan(t):
    """Three document shapes by event id: array, wrapped array, plain object."""
    row = F.struct("event_id", "event_type", "value")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.to_json(F.array(row))).when(k == 1, F.to_json(F.struct(F.array(row).alias("records")))).otherwise(F.to_json(row))
    path = work_folder(t.spark, "docs")
    t.events.select(raw.alias("value")).write.text(path)
    return S.unwrap_json(t.spark.read.text(path).withColumnRenamed("value", "raw"), "raw", "event_id bigint, event_type string, value double")


@query("jsonl_scan", "SELECT 'good' AS kind, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT 'bad', count(*), NULL FROM events WHERE event_id % 10 = 0")
def jsonl_scan(t):
    """Every tenth line is cut off in the middle."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    path = work_folder(t.spark, "jsonl")
    t.events.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 15)).otherwise(line).alias("value")).write.text(path)
    schema = t.events.select("event_id", "event_type", "value").schema
    good, bad = S.read_json_lines(t.spark, path, schema)
    g = good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))
    return g.unionByName(bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("bigint").alias("ids")))


@query("parquet_scan", "SELECT event_id, user_id, value FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'")
def parquet_scan(t):
    path = work_folder(t.spark, "days")
    S.write_partitioned(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), path, ["day"])
    return S.read_partition(t.spark, path, "day", "2024-01-15").select("event_id", "user_id", "value")


@query("partitioned_write", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", digits="total:2")
def partitioned_write(t):
    """Written twice: the second write replaces its partitions."""
    path = work_folder(t.spark, "types")
    S.write_partitioned(t.events, path, ["event_type"])
    S.write_partitioned(t.events.where("event_type = 'click'"), path, ["event_type"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("bucketed_write", "SELECT o_orderstatus, count(*) AS lines, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", digits="qty")
def bucketed_write(t):
    """Both sides bucketed by the order key: the join itself needs no shuffle."""
    path = work_folder(t.spark, "buckets")
    name = path.rsplit("-", 1)[1]
    S.write_bucketed(t.orders.select("o_orderkey", "o_orderstatus"), f"b_orders_{name}", f"{path}/orders", "o_orderkey", 8)
    S.write_bucketed(t.lineitem.select("l_orderkey", "l_quantity"), f"b_lines_{name}", f"{path}/lines", "l_orderkey", 8)
    a, b = t.spark.table(f"b_orders_{name}"), t.spark.table(f"b_lines_{name}")
    return a.join(b.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))


@query("bronze_ingest", "SELECT event_type, count(*) AS n, true AS has_source, '2024-02-01' AS loaded FROM events GROUP BY 1")
def bronze_ingest(t):
    path = work_folder(t.spark, "bronze")
    t.events.select("event_id", "event_type", "value").write.json(f"{path}/raw")
    schema = t.events.select("event_id", "event_type", "value").schema
    S.bronze_ingest(t.spark, f"{path}/raw", schema, f"{path}/bronze", "2024-02-01 00:00:00")
    rows = t.spark.read.parquet(f"{path}/bronze")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_source_file").endswith(".json")).alias("has_source"), F.date_format(F.max("_ingested_at"), "yyyy-MM-dd").alias("loaded"))


@query("schema_merge_read", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority FROM orders")
def schema_merge_read(t):
    """Older files lack the priority column."""
    path = work_folder(t.spark, "merge")
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    t.orders.where(old).select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/part=1")
    t.orders.where(~old).select("o_orderkey", "o_orderstatus", "o_orderpriority").write.parquet(f"{path}/part=2")
    return S.read_merged(t.spark, path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("bulk_load", "SELECT 'loaded' AS kind, count(*) AS rows FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderkey % 10 = 0")
def bulk_load(t):
    k = F.col("o_orderkey")
    target = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    staged = t.orders.select(F.when(k % 10 == 0, "ten cents").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"), (k + 10_000_000).cast("string").alias("o_orderkey"))
    good, bad = S.bulk_load(target, staged, {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"})
    n = F.count(F.lit(1)).alias("rows")
    return good.agg(F.lit("loaded").alias("kind"), n).unionByName(bad.agg(F.lit("rejected").alias("kind"), n))


RULES = '{"columns": [{"name": "o_orderstatus", "nullable": false, "allowed_values": ["F", "O"]}, {"name": "o_totalprice", "type": "float", "max_value": 400000}, {"name": "o_orderpriority", "pattern": "^[1-3]-"}]}'


@query(
    "schema_loader",
    "SELECT 'not_null' AS \"check\", 'o_orderstatus' AS \"column\", 0 AS failed UNION ALL SELECT 'allowed_values', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'data_type', 'o_totalprice', 0 "
    "UNION ALL SELECT 'value_range', 'o_totalprice', count(*) FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'pattern_match', 'o_orderpriority', count(*) FROM orders WHERE o_orderpriority >= '4'",
)
def schema_loader(t):
    return Q.validate(t.orders, S.load_rules(RULES)).select("check", "column", "failed")


@query("text_corpus_scan", "SELECT count(*) AS files, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents")
def text_corpus_scan(t):
    """One file per document, read back whole."""
    path = work_folder(t.spark, "corpus")
    S.write_text_corpus(t.documents, "text", path)
    return S.read_text_corpus(t.spark, path, "*.txt").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


# ---- streams ----------------------------------------------------------------


def stream(t):
    return R.file_stream(t.spark, t.folder, t.events, glob="events.parquet")


def plain(df):
    """Zoned times back to plain ones."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


@query("file_stream_source", "SELECT event_id, user_id, event_type, value FROM events")
def file_stream_source(t):
    return R.appended(stream(t).select("event_id", "user_id", "event_type", "value"), "source")


@query("kafka_source", "SELECT event_id, event_type, value FROM events")
def kafka_source(t):
    """Messages with a JSON value, as the Kafka source delivers them, parsed from a file stream."""
    messages = stream(t).select(F.to_json(F.struct("event_id", "event_type", "value")).cast("binary").alias("value"))
    return R.appended(S.parse_messages(messages, "event_id bigint, event_type string, value double").drop("_raw"), "messages")


WIN = "date_trunc('day', ts) + INTERVAL ((hour(ts) * 60 + minute(ts)) // {m} * {m}) MINUTE"
CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query(
    "watermark",
    f"SELECT * FROM (SELECT {WIN.format(m=5)} AS start, {WIN.format(m=5)} + INTERVAL 5 MINUTE AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL) WHERE \"end\" {CLOSED}",
    digits="total",
)
def watermark(t):
    """Append mode: only windows behind the watermark come out."""
    return plain(R.appended(R.window_counts(stream(t), ["event_type"], "ts", "value", "5 minutes"), "watermark"))


@query(
    "tumbling_window",
    f"SELECT {WIN.format(m=1)} AS start, {WIN.format(m=1)} + INTERVAL 1 MINUTE AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    digits="total",
)
def tumbling_window(t):
    out = R.window_counts(stream(t), ["event_type"], "ts", "value", "1 minute")
    return plain(R.upserted(out, ["start", "event_type"], "update", "tumbling"))


@query(
    "sliding_window",
    f"SELECT s AS start, s + INTERVAL 5 MINUTE AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM (SELECT {WIN.format(m=1)} - INTERVAL (i) MINUTE AS s, event_type, value FROM events, range(5) r(i)) GROUP BY ALL",
    digits="total",
)
def sliding_window(t):
    out = R.window_counts(stream(t), ["event_type"], "ts", "value", "5 minutes", "1 minute")
    return plain(R.upserted(out, ["start", "event_type"], "update", "sliding"))


SESSIONS = """
    g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    z AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, s)
"""


@query("session_window", f"WITH {SESSIONS} SELECT user_id, start, last + INTERVAL 30 MINUTE AS \"end\", n FROM z WHERE last + INTERVAL 30 MINUTE {CLOSED}")
def session_window(t):
    return plain(R.appended(R.session_counts(stream(t), "user_id", "ts", "30 minutes"), "sessions"))


@query("stateful_session", f"WITH {SESSIONS} SELECT user_id, epoch_us(start) AS start_us, epoch_us(last) AS end_us, n FROM z WHERE last + INTERVAL 30 MINUTE {CLOSED}")
def stateful_session(t):
    return R.appended(R.stateful_sessions(stream(t), "user_id", "ts", 1800), "state")


@query(
    "late_data",
    f"SELECT * FROM (SELECT {WIN.format(m=5)} AS start, {WIN.format(m=5)} + INTERVAL 5 MINUTE AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) WHERE \"end\" {CLOSED}",
    digits="total",
)
def late_data(t):
    """The older half arrives last, behind the watermark, and is dropped.

    A batch drops late rows by the watermark of the batch before it, so two batches come first.
    """
    day = F.to_date("ts")
    spans = (("2024-01-15", "2024-01-29"), ("2024-01-29", "2024-12-31"), ("2024-01-01", "2024-01-15"))
    parts = [t.events.where((day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date"))) for lo, hi in spans]
    out = work_folder(t.spark, "late")
    build = lambda rows: R.window_counts(rows, ["event_type"], "ts", "value", "5 minutes")
    R.delivered(parts, lambda rows, checkpoint: R.run_append(build(rows), out, checkpoint), t.events, "late-input")
    return plain(t.spark.read.parquet(out))


@query(
    "output_modes",
    f"WITH w AS (SELECT {WIN.format(m=5)} + INTERVAL 5 MINUTE AS e, event_type FROM events GROUP BY ALL) SELECT 'append' AS mode, count(*) AS windows FROM w WHERE e {CLOSED} UNION ALL SELECT 'update', count(*) FROM w UNION ALL SELECT 'complete', count(*) FROM w",
)
def output_modes(t):
    """Append holds the closed windows, update and complete hold all."""
    out = R.window_counts(stream(t), ["event_type"], "ts", "value", "5 minutes")
    n = F.count(F.lit(1)).alias("windows")
    a = R.appended(out, "mode").agg(F.lit("append").alias("mode"), n)
    for mode in ("update", "complete"):
        a = a.unionByName(R.upserted(out, ["start", "event_type"], mode, "mode").agg(F.lit(mode).alias("mode"), n))
    return a


@query("foreach_batch_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def foreach_batch_upsert(t):
    """Four batches in time order; the table keeps the newest row of each user."""
    day = F.dayofmonth("ts")
    parts = [t.events.where((day >= lo) & (day < hi)) for lo, hi in ((1, 8), (8, 16), (16, 24), (24, 32))]
    table = R.BucketedTable(t.spark, work_folder(t.spark, "newest"), "user_id")

    def sink(batch, number):
        table.write(batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts")), number)

    def start(rows, checkpoint):
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()

    R.delivered(parts, start, t.events, "batches")
    return plain(table.read())


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(t):
    """Every event is delivered twice, in two batches."""
    out = work_folder(t.spark, "once")
    build = lambda rows: R.dedup(rows, ["event_id"], "ts", "60 days").select("event_id", "event_type")
    R.delivered([t.events] * 2, lambda rows, checkpoint: R.run_append(build(rows), out, checkpoint), t.events, "twice")
    return t.spark.read.parquet(out)


@query("trigger_checkpoint", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def trigger_checkpoint(t):
    """Two runs on one checkpoint: the second finds nothing new."""
    path = work_folder(t.spark, "trigger")
    rows = stream(t).select("event_id", "event_type")
    for _ in range(2):
        R.run_append(rows, f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("lambda_merge", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def lambda_merge(t):
    """Batch view up to the boundary, live view from it on."""
    cut = F.lit("2024-01-20")
    day = F.to_date("ts").alias("day")
    batch = t.events.where(F.col("ts") < cut.cast("timestamp_ntz")).groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"))
    live = stream(t).where(F.col("ts") >= cut.cast("timestamp")).groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"))
    return batch.unionByName(R.upserted(live, ["event_type", "day"], "update", "live"))


@query("replay", "SELECT event_id, event_type, value * 2 AS doubled FROM events WHERE ts >= TIMESTAMP '2024-01-20'", digits="doubled")
def replay(t):
    """A corrected computation runs again from a time on."""
    build = lambda df: df.select("event_id", "event_type", (F.col("value") * 2).alias("doubled"))
    return R.replay(t.spark, t.folder, t.events, "2024-01-20", build, "events_live", "events.parquet")


@query("stream_progress", "SELECT count(*) AS input_rows FROM events")
def stream_progress(t):
    return R.progress_rows(stream(t).select("event_id"), "progress").agg(F.sum("input_rows").alias("input_rows"))
