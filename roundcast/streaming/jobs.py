"""Streaming jobs: sources, sinks and the queries between them.

Every job is its own query with its own checkpoint, so one failing sink does not
stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.features import feature_frame, scoreable
from roundcast.functions.scoring import prediction_columns
from roundcast.operators.labels import upsert
from roundcast.session import checkpointed, scratch_path
from roundcast.sources.rules import checked, split_valid
from roundcast.streaming.processor import STATE_CONF, stream_momentum

#: Files that one micro-batch of a file stream admits.
FILES_PER_BATCH = 64


def configure_state(spark: SparkSession) -> SparkSession:
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    return spark


def read_table_stream(
    spark: SparkSession, folder: str, pattern: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; ``pattern`` selects file names, ``options`` may admit more or fewer."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .options(**{"maxFilesPerTrigger": str(FILES_PER_BATCH), **dict(options or {})})
        .parquet(folder)
    )


def ingest(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages to (valid events, quarantined rows); bad payloads never stop the stream."""
    return split_valid(checked(messages, value))


def run_to_end(
    df: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    state_partitions: int | None = None,
    timeout_seconds: float | None = None,
) -> str:
    """Drain what is there into a Parquet folder, then stop; with no timeout, however long it takes.

    State is kept per shuffle partition and their number is fixed by the first
    start; ``state_partitions`` sets it for this query only.
    """
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path)
    _drain(df.sparkSession, writer, checkpoint, state_partitions, timeout_seconds)
    return path


def run_batches(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    state_partitions: int | None = None,
    timeout_seconds: float | None = None,
) -> None:
    """Drain what is there through a batch writer, then stop."""
    writer = df.writeStream.foreachBatch(write).outputMode(mode)
    _drain(df.sparkSession, writer, checkpoint, state_partitions, timeout_seconds)


def _start(spark: SparkSession, writer, checkpoint: str, state_partitions: int | None = None):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if state_partitions:
        spark.conf.set(name, str(state_partitions))
    try:
        # a started query keeps its own copy of the settings
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def _drain(
    spark: SparkSession, writer, checkpoint: str, state_partitions: int | None, timeout_seconds: float | None
) -> None:
    query = _start(spark, writer, checkpoint, state_partitions)
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"the streaming query took more than {timeout_seconds} seconds")


def run_isolated(
    df: DataFrame,
    sinks: Mapping[str, tuple[Callable[[DataFrame, int], None], str]],
    restarts: int = 2,
) -> dict[str, tuple[str, int, str]]:
    """Drain a stream into several sinks, each a query of its own: one that fails stops no other.

    ``sinks`` names a batch writer and a checkpoint folder each. A failed query starts again from its checkpoint, at
    most ``restarts`` times, and so writes the batch that failed once more. The report has (state, restarts, error) of
    each sink; the state is "complete" or "failed".
    """
    spark = df.sparkSession

    def start(name: str):
        write, checkpoint = sinks[name]
        return _start(spark, df.writeStream.foreachBatch(write).outputMode("append"), checkpoint)

    running = {name: (start(name), 0) for name in sinks}
    report = {}
    while running:
        for name, (query, used) in list(running.items()):
            try:
                if not query.awaitTermination(0.2):
                    continue
                report[name] = ("complete", used, "")
            except StreamingQueryException as error:
                if used < restarts:
                    running[name] = (start(name), used + 1)
                    continue
                report[name] = ("failed", used, str(error))
            del running[name]
    return report


def write_first(
    path: str, n: int, order: Sequence[str], run: str
) -> Callable[[DataFrame, int], None]:
    """Batch writer of the first ``n`` events of a stream; further ones are read and left out.

    A batch comes before the next one; within a batch ``order`` decides, whose columns have to name an event. How many
    are still wanted is read from what the batches before have written under the same ``run``, so a restart goes on
    counting and a batch that is tried again takes the same events. A batch is cut at the event of the wanted rank:
    ranges of the order are counted, and only the range with that rank is sorted for it.
    """
    if n < 0:
        raise ValueError(f"{n} events")
    folder = _run_folder(path, run)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = 0
        if batch_id:
            done = spark.read.schema("batch long").parquet(folder)
            taken = done.filter(F.col("batch") < batch_id).count()
        left = n - taken
        key = F.struct(*order)
        ranged = batch.select(key.alias("key")).repartitionByRange("key").select("key", F.spark_partition_id().alias("part"))
        chosen = batch.limit(0)
        if left > 0:
            ranged = checkpointed(ranged)
            chosen = batch
            for part, size in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):
                if left <= size:
                    last = ranged.filter(F.col("part") == part).sort("key").offset(left - 1).limit(1)
                    chosen = batch.filter(key <= last.select("key").scalar())
                    break
                left -= size
        chosen.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def take_first(df: DataFrame, n: int, path: str, checkpoint: str, order: Sequence[str], run: str = "0") -> str:
    """Drain a stream until ``n`` events are written, then stop; a later call with the same folders goes on counting."""
    write = write_first(path, n, order, run)
    query = _start(df.sparkSession, df.writeStream.foreachBatch(write).outputMode("append"), checkpoint)
    folder, seen = _run_folder(path, run), -1
    while not query.awaitTermination(1):
        done = query.lastProgress
        if done is not None and done["batchId"] > seen:
            seen = done["batchId"]
            # a batch that is being written doesn't count yet
            held = df.sparkSession.read.schema("batch long").parquet(folder)
            if held.filter(F.col("batch") <= seen).count() >= n:
                query.stop()
    return path


def _run_folder(path: str, run: str | None) -> str:
    """Batches of a run lie under a name of its own: a new checkpoint counts from 0 again and must not replace them.

    Names are to grow with time, the newest run having the last one, and to stay with a checkpoint: a restart that goes
    on with a checkpoint gives its name again and so replaces the batch it had begun.
    """
    return f"{path}/run={run or f'{datetime.now(UTC):%Y%m%dT%H%M%S%f}'}"


def write_updates(path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps each batch's changed rows; a retried batch replaces itself."""
    folder = _run_folder(path, run)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def write_latest(
    path: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], run: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch writer of the last arrival per key, without any streaming state.

    A later batch is a later arrival whatever its rows say; ``order`` decides within a batch. Busy keys are combined
    before they are shuffled.
    """
    write = write_updates(path, run)

    def reduce_and_write(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("__row")
        rows = batch.groupBy(*keys).agg(newest)
        write(rows.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns]), batch_id)

    return reduce_and_write


def read_updates(
    spark: SparkSession, path: str, keys: Sequence[str], fresh: Column | None = None
) -> DataFrame:
    """Current rows of an update table: per key, the row of the newest batch of the newest run.

    ``fresh`` says which rows are still alive, for example by their age.
    """
    rows = spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    columns = [c for c in rows.columns if c not in (*keys, "run", "batch")]
    current = upsert(rows, keys, ["run", "batch"], columns)
    return current if fresh is None else current.filter(fresh)


def compact_updates(
    spark: SparkSession, path: str, to: str, keys: Sequence[str], fresh: Column | None = None
) -> str:
    """The current rows alone, as the first run of a new update table; expired ones are left behind."""
    read_updates(spark, path, keys, fresh).write.parquet(f"{_run_folder(to, None)}/batch=0")
    return to


def score_ticks(
    ticks: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    names: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("match_id", "sequence", "round_number"),
    with_features: bool = False,
) -> DataFrame:
    """Prediction rows of the scoreable ticks; the others are left out.

    ``score`` adds ``ct_win_probability`` to a feature frame, for example the ``scorer`` of a stored model. ``ticks``
    carries the tick columns and the momentum. ``with_features`` keeps what the prediction was made from.
    """
    rows = ticks.filter(scoreable(F.col("phase")))
    scored = score(feature_frame(rows, list(keep), names))
    p = F.col("ct_win_probability")
    columns = prediction_columns(p)
    return scored.select(
        *keep,
        F.round(p, 6).alias("ct_win_probability"),
        F.round(columns[1], 6).alias("t_win_probability"),
        columns[2],
        F.round(columns[3], 6).alias("confidence"),
        *(fv.FEATURES if with_features else ()),
    )


def score_stream(
    events: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    keep: Sequence[str] = ("round_number",),
    with_features: bool = False,
    **windows,
) -> DataFrame:
    """Predictions of a stream of events: momentum from the state of the match, all else from the tick.

    ``columns`` names the tick columns that the features read, momentum aside; ``keep`` is added to match and sequence
    in the result. ``windows`` goes to ``stream_momentum``. The stateful operator is the only shuffle.
    """
    carried = tuple(dict.fromkeys((*columns, *keep)))
    ticks = stream_momentum(events, keep=carried, **windows).withColumnsRenamed(
        {"kills_ct": "kills_ct_window", "kills_t": "kills_t_window"}
    )
    return score_ticks(ticks, score, keep=("match_id", "sequence", *keep), with_features=with_features)


def prediction_messages(scored: DataFrame, arrived: str = "arrived") -> DataFrame:
    """Key and JSON payload of each prediction for a topic; the match is the key, so its predictions keep their order.

    ``timestamp`` is the clock of the micro-batch that scored the tick, ``latency_ms`` the time since the tick arrived
    at the source, such as a topic's record time: 0 where the clocks disagree, null without an arrival.
    """
    now = F.current_timestamp()
    waited = F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(F.col(arrived))) / 1000
    payload = F.struct(
        "match_id",
        "sequence",
        now.alias("timestamp"),
        "round_number",
        "ct_win_probability",
        "t_win_probability",
        "favoured_side",
        "confidence",
        F.when(F.col(arrived).isNotNull(), F.round(waited, 4)).alias("latency_ms"),
    )
    return scored.select(
        F.col("match_id").cast("string").cast("binary").alias("key"),
        F.to_json(payload, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
    )


PREDICTION_SCHEMA = (
    "match_id string, sequence long, timestamp timestamp, round_number int, ct_win_probability double, "
    "t_win_probability double, favoured_side string, confidence double, latency_ms double"
)


def read_predictions(messages: DataFrame, value: str = "value") -> DataFrame:
    """Predictions out of their messages."""
    return messages.select(F.from_json(F.col(value).cast("string"), PREDICTION_SCHEMA).alias("p")).select("p.*")


def route_batch(
    routes: Mapping[str, tuple[Callable[[DataFrame], DataFrame], str]], run: str | None = None, counts: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch writer for several tables: each route picks rows and names a folder.

    The batch is read once and kept while the routes write; writing a folder per
    batch id makes a retry replace its own output, and one per run keeps other runs' output.
    ``counts``: a folder for the rows that each route wrote in each batch, observed while they were written.
    """
    folders = {name: _run_folder(path, run) for name, (_, path) in routes.items()}
    counted = counts and _run_folder(counts, run)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            seen = []
            for name, (pick, _) in routes.items():
                observed = Observation()
                rows = pick(batch).observe(observed, F.count(F.lit(1)).alias("rows"))
                rows.write.mode("overwrite").parquet(f"{folders[name]}/batch={batch_id}")
                seen.append((name, observed.get["rows"]))
            if counted:
                rows = batch.sparkSession.createDataFrame(seen, "route string, rows long")
                rows.coalesce(1).write.mode("overwrite").parquet(f"{counted}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def sink_counters(spark: SparkSession, counts: str) -> DataFrame:
    """Per route: rows ``written``, ``flushes`` (batches) and ``mean_rows`` of a flush, 0 where there was none."""
    rows = spark.read.schema("route string, rows long").parquet(counts)
    return rows.groupBy("route").agg(
        F.sum("rows").alias("written"), F.count(F.lit(1)).alias("flushes"), F.coalesce(F.avg("rows"), F.lit(0.0)).alias("mean_rows")
    )


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A value state of a finished or stopped query: key columns and state columns, one row per key that holds one."""
    held = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    value = "value.value.*" if "value" in held.schema["value"].dataType.names else "value.*"
    return held.select("key.*", value)


def scratch_pair(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) for one run."""
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-log")
