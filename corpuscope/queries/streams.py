"""Registered streams: run over the event table to its end, then read what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuscope.operators import corpus
from corpuscope.queries.code import PRED_SQL
from corpuscope.queries.usage import MECH_SQL
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import tables as T
from corpuscope.sources import tree
from corpuscope.streaming import changes, loops, usage

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


TRIGGERS = 4


def _stream(spark: SparkSession, folder: str, order: str = "ts", closed: bool = True) -> DataFrame:
    """The event table as a stream of several micro-batches, in the order of a column; ``closed`` adds a last event, of no user,
    long after all others, which closes what is open at the end."""
    base = f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{folder}/events.parquet").select(*[c.split()[0] for c in EVENTS.split(", ")])
    place = F.unix_micros(F.col(order).cast("timestamp")) if order == "ts" else F.col(order)
    cuts = events.agg(F.percentile_approx(place, [k / TRIGGERS for k in range(1, TRIGGERS)], 1000)).first()[0] or []
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = events.where((F.lit(True) if lo is None else place > lo) & (F.lit(True) if hi is None else place <= hi))
        part.write.parquet(f"{base}/slice-{k}")
    if closed:
        last = events.agg((F.max("event_id") + 10**9).alias("event_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
        last.select(
            "event_id", "ts", F.lit(-1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"),
            F.lit(None).cast("string").alias("props"),
        ).write.parquet(f"{base}/slice-{TRIGGERS}")
    each = max(1, len(spark.read.parquet(f"{base}/*").inputFiles()) // (TRIGGERS + closed))
    return (
        spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", each).parquet(f"{base}/*")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def _drain(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all batches (append), or the latest row of each key (update), through the shared folder."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out")
    if mode == "update":
        values = [c for c in out.columns if c not in (*keys, "batch")]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
        return out.select(*stream.columns)
    return out.drop("batch")


def _file_changes(events: DataFrame, above: Column | None = None) -> DataFrame:
    return events.select(
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"),
        F.concat(
            F.lit("") if above is None else above, F.lit("/f"),
            (F.get_json_object("props", "$.k").cast("int") / 20).cast("int"), F.lit(".ts"),
        ).alias("file"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("change").alias("action"),
        "ts",
    )


def _settled(spark, folder):
    e = _file_changes(_stream(spark, folder))
    return _drain(changes.settled(e, "10 minutes", "1 hour"), "append").withColumn("ts", F.unix_micros("ts"))


def _deletions(spark, folder):
    e = _file_changes(_stream(spark, folder, closed=False))
    return _drain(changes.deletions(e), "append").withColumn("ts", F.unix_micros("ts"))


def _change_log(spark, folder):
    """The changes as JSON files, read as the change source reads them; ignored and generated paths drop out."""
    base = f"{ensure_checkpoint_dir(spark)}/changes-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    tail = F.when(F.col("event_id") % 5 == 0, "/node_modules").when(F.col("event_id") % 7 == 0, "/dist").otherwise("")
    _file_changes(events, tail).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(base)
    return _drain(changes.read_changes(spark, base), "append").withColumn("ts", F.unix_micros("ts"))


def _live(spark, folder):
    eid, kind = F.col("event_id"), F.col("event_type")
    e = _stream(spark, folder, closed=False).select(
        "ts", F.floor("value").alias("tokens_saved"),
        F.when(kind == "click", "search").when(kind == "view", F.when(eid % 3 == 0, "cache_hit").otherwise("file_read"))
        .when(kind == "purchase", "index_substitute").when(kind == "signup", "compression").otherwise("search_savings")
        .alias("event_type"),
    )
    return _drain(usage.live_timeline(e), "update", ("bucket_ts", "mechanism")).withColumn("bucket_ts", F.unix_micros("bucket_ts"))


def _turns(spark, folder):
    e = _stream(spark, folder).select(
        F.concat(F.lit("s"), F.col("user_id") % 5).alias("session_id"), F.floor("value").alias("tokens_saved"), "ts"
    )
    return _drain(usage.turns(e, "5 minutes", "1 minute"), "append")


def _reads(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("s"), F.col("user_id") % 4).alias("session_id"),
        F.concat(F.lit("/f"), (F.get_json_object("props", "$.k").cast("int") / 50).cast("int")).alias("path"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 173_000).alias("ts"),
    )


def _loops(spark, folder):
    return _drain(loops.live_loops(_reads(_stream(spark, folder, "event_id"))), "append").withColumn("ts", F.unix_micros("ts"))


def _recent_edits(spark, folder):
    """Edits are remembered for a day after the first one."""
    e = _stream(spark, folder, closed=False).select(
        F.concat(F.lit("s"), "user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("path"), "ts")
    return _drain(loops.recent_edits(e, "60 days"), "append").select("session_id", "path")


def _unedited(spark, folder):
    """Every event reads or edits a file; purchases are edits."""
    e = _stream(spark, folder).select(
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), "event_type",
        F.concat(F.lit("/f"), (F.get_json_object("props", "$.k").cast("int") / 20).cast("int")).alias("path"), "ts")
    edit = F.col("event_type") == "purchase"
    return _drain(loops.unedited_reads(e.where(~edit), e.where(edit)), "append").withColumn("ts", F.unix_micros("ts"))


def _tree(spark, folder):
    """(base, roots) of a fresh folder for the documents as files, one tree for each project."""
    base = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    sources = spark.read.parquet(f"{folder}/documents.parquet").select("source").distinct().collect()  # one row a project
    return base, {f"p{r.source[3:]}": f"{base}/work/{r.source}" for r in sources if r.source}


def _below(column):
    return F.regexp_replace(column, "^.*/tree-[0-9a-f]{32}", "")


def _read_tree(spark, folder):
    """Documents written as files, listed by the source and read."""
    base, roots = _tree(spark, folder)
    tree.write_tree(T.files(spark, folder), base)
    out = corpus.read_listed(tree.list_tree(spark, roots))
    return out.select("project_id", _below("file").alias("file"), "length", F.sha2("content", 256).alias("sha"))


def _tree_changes(spark, folder):
    """The tree without a fifth of the files; then a seventh of all is written anew and an eleventh removed."""
    base, roots = _tree(spark, folder)
    files, doc = T.files(spark, folder), F.col("doc_id")
    state, out = f"{base}-state", f"{base}-out"

    def run(number):
        stream = tree.tree_changes(spark, roots, f"{state}/snapshots")
        query = (
            stream.writeStream.option("checkpointLocation", f"{state}/query").trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/run={number}/batch={n}")).start()
        )
        query.awaitTermination()

    tree.write_tree(files.where(doc % 5 != 0), base)
    run(0)
    anew = files.where((doc % 7 == 0) & (doc % 11 != 3)).withColumn("content", F.concat("content", F.lit("x")))
    gone = files.where((doc % 5 != 0) & (doc % 11 == 3)).withColumn("content", F.lit(None).cast("string"))
    tree.write_tree(anew.unionByName(gone), base)
    run(1)
    rows = spark.read.schema(tree.CHANGES + ", run INT, batch INT").parquet(out)
    return rows.select(F.col("run").cast("bigint").alias("run"), "project_id", _below("file").alias("file"), "action", "length")


ISLANDS = """
{name}_o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY {key} ORDER BY ts) + INTERVAL {gap} THEN 0 ELSE 1 END AS b FROM {src}),
{name} AS (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY ts) AS g FROM {name}_o)"""

QUERIES = {
    "r2_settled_changes": (
        _settled,
        f"""WITH c AS (SELECT 'p' || user_id % 3 AS project_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 20 || '.ts' AS file,
          CASE event_type WHEN 'signup' THEN 'add' ELSE 'change' END AS action, ts FROM events WHERE event_type <> 'error'),
        {ISLANDS.format(name='i', key='project_id, file', gap='10 minutes', src='c')},
        r AS (SELECT project_id, file, arg_max(action, ts) AS action, max(ts) AS last, count(*) AS events FROM i GROUP BY project_id, file, g)
        SELECT project_id, file, action, epoch_us(last) AS ts, events FROM r""",
    ),
    "r2_deletions": (
        _deletions,
        """SELECT 'p' || user_id % 3 AS project_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 20 || '.ts' AS file,
          'delete' AS action, epoch_us(ts) AS ts FROM events WHERE event_type = 'error'""",
    ),
    "r1_change_source": (
        _change_log,
        """SELECT 'p' || user_id % 3 AS project_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 20 || '.ts' AS file,
          CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'change' END AS action, epoch_us(ts) AS ts
          FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""",
    ),
    "s1_source_tree": (
        _read_tree,
        f"WITH {PRED_SQL} SELECT project_id, file, length, sha256(content) AS sha FROM kept",
    ),
    "r1_tree_changes": (
        _tree_changes,
        f"""WITH {PRED_SQL}, f AS (SELECT *, doc_id % 5 <> 0 AS was, (doc_id % 5 <> 0 OR doc_id % 7 = 0) AND doc_id % 11 <> 3 AS is_ FROM pred WHERE NOT ignored)
        SELECT CAST(0 AS BIGINT) AS run, project_id, file, 'add' AS action, length FROM f WHERE was
        UNION ALL SELECT 1, project_id, file, CASE WHEN NOT is_ THEN 'delete' WHEN NOT was THEN 'add' ELSE 'change' END,
          CASE WHEN is_ THEN length + 1 END FROM f WHERE (was AND NOT is_) OR (is_ AND NOT was) OR (is_ AND doc_id % 7 = 0)""",
    ),
    "r7_recent_edits": (
        _recent_edits,
        """SELECT DISTINCT 's' || user_id AS session_id, json_extract_string(props, '$.k') AS path FROM events""",
    ),
    "j7_r7_live_guard": (
        _unedited,
        """WITH e AS (SELECT 's' || user_id % 10 AS session_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 20 AS path, ts,
          event_type = 'purchase' AS edit FROM events)
        SELECT session_id, path, epoch_us(ts) AS ts FROM e r WHERE NOT edit AND NOT EXISTS (SELECT 1 FROM e x WHERE x.edit
          AND x.session_id = r.session_id AND x.path = r.path AND x.ts <= r.ts AND x.ts >= r.ts - INTERVAL 24 HOURS)""",
    ),
    "r4_live_timeline": (
        _live,
        f"""WITH e AS (SELECT ts, CAST(floor(value) AS BIGINT) AS s, CASE event_type WHEN 'click' THEN 'search'
          WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'cache_hit' ELSE 'file_read' END WHEN 'purchase' THEN 'index_substitute'
          WHEN 'signup' THEN 'compression' ELSE 'search_savings' END AS event_type FROM events)
        SELECT epoch_us(date_trunc('hour', ts)) AS bucket_ts, coalesce({MECH_SQL}, 'none') AS mechanism, count(*) AS count,
          CAST(sum(s) AS BIGINT) AS saved FROM e GROUP BY 1, 2""",
    ),
    "r5_turn_savings": (
        _turns,
        f"""WITH c AS (SELECT 's' || user_id % 5 AS session_id, CAST(floor(value) AS BIGINT) AS v, ts FROM events),
        {ISLANDS.format(name='i', key='session_id', gap='5 minutes', src='c')},
        r AS (SELECT session_id, sum(v) AS s, count(*) AS n, min(ts) AS a, max(ts) AS z FROM i GROUP BY session_id, g)
        SELECT session_id, CAST(s AS BIGINT) AS tokens_saved, n AS tools_intercepted, (epoch_us(z) - epoch_us(a)) // 1000 AS duration_ms
        FROM r WHERE s <> 0""",
    ),
    "r6_live_loops": (
        _loops,
        """WITH r AS (SELECT 's' || user_id % 4 AS session_id, '/f' || CAST(json_extract_string(props, '$.k') AS INT) // 50 AS path,
          event_id * 173000 AS us FROM events),
        f AS (SELECT *, min(us) OVER (PARTITION BY session_id, path) AS a FROM r),
        n AS (SELECT *, CASE WHEN us // 1000 - a // 1000 < 300000 THEN row_number() OVER (PARTITION BY session_id, path ORDER BY us) ELSE 1 END AS k FROM f)
        SELECT session_id, path, 1704067200000000 + us AS ts, k AS count, k >= 3 AS looping FROM n""",
    ),
}
