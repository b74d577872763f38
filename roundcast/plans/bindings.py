"""How the benchmark tables play the part of telemetry tables.

Each binding is a set of SQL projections over one table, row by row and without
filters, so every query reads the whole table. The texts are plain SQL that both
Spark and the checking engine evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import once
from roundcast.session import use_utc

MOMENTUM_SPAN = 172_800.0  # events lie hours apart


def _case(subject: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {subject} {arms} END"


# events: one user is a match, signup opens a round, purchase is a kill, error ends
# a round, view and click are ticks.
EVENT = {
    "match_id": "user_id",
    "sequence": "event_id",
    "timestamp": "ts",
    "event_type": (
        "CASE event_type WHEN 'signup' THEN 'round_start' WHEN 'purchase' THEN 'kill' "
        "WHEN 'error' THEN 'round_end' ELSE 'tick' END"
    ),
    "round_number": "CAST(event_id % 24 + 1 AS INT)",
    "victim_team": "CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'CT' END",
    "headshot": "value > 20",
    "winner": "CASE WHEN event_id % 3 = 0 THEN 'T' ELSE 'CT' END",
    "reason": (
        "CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 30 THEN 'bomb_exploded' "
        "ELSE 'ct_eliminated' END ELSE CASE WHEN value > 60 THEN 'time_expired' "
        "WHEN value > 30 THEN 'bomb_defused' ELSE 't_eliminated' END END"
    ),
    "score_ct": "CAST(event_id % 13 AS INT)",
    "score_t": "CAST(event_id % 7 AS INT)",
    "probability": "value / (value + 20)",
    "value": "value",
}

# lineitem: an order is a match with one round, a line is a tick; repeated lines of
# an order are replays.
TICK = {
    "match_id": "concat('m', CAST(l_orderkey AS STRING))",
    "sequence": "CAST(l_linenumber AS BIGINT)",
    "timestamp": "l_shipdate",
    "map_name": _case("l_suppkey % 7", fv.MAPS),
    "round_number": "CAST(l_orderkey % 24 + 1 AS INT)",
    "phase": (
        "CASE WHEN l_returnflag = 'R' THEN 'bomb_planted' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'freezetime' "
        "WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 'over' ELSE 'live' END"
    ),
    "seconds_remaining": "l_quantity * 2 + 15",
    "bomb_planted": "l_returnflag = 'R'",
    "bomb_seconds": "CASE WHEN l_returnflag = 'R' THEN l_discount * 400 END",
    "score_ct": "CAST(l_partkey % 13 AS INT)",
    "score_t": "CAST(l_suppkey % 13 AS INT)",
    "alive_ct": "CAST(l_partkey % 6 AS INT)",
    "alive_t": "CAST((l_suppkey + l_linenumber) % 6 AS INT)",
    "health_ct": "CAST((l_partkey % 6) * (40 + l_linenumber * 7) AS INT)",
    "health_t": "CAST(((l_suppkey + l_linenumber) % 6) * (20 + l_partkey % 80) AS INT)",
    "money_ct": "CAST((l_orderkey * 13 + l_partkey * 7) % 60001 AS INT)",
    "money_t": "CAST((l_partkey * 37 + l_suppkey) % 60001 AS INT)",
    "equipment_ct": "CAST((l_partkey * 131 + l_orderkey * 7) % 30001 AS INT)",
    "equipment_t": "CAST((l_suppkey * 517 + l_orderkey * 11) % 30001 AS INT)",
    "losses_ct": "CAST(l_linenumber % 6 AS INT)",
    "losses_t": "CAST(l_orderkey % 6 AS INT)",
    "kills_ct_window": "CAST(l_partkey % 4 AS INT)",
    "kills_t_window": "CAST(l_suppkey % 4 AS INT)",
    "window_seconds": "l_tax * 150",
}

# lineitem once more, as events: ten matches for two thousand orders each, whose lines come a second apart and are
# ticks, kills or round starts, with all columns of a tick.
FEED = {
    **TICK,
    "match_id": "concat('s', CAST(CAST(floor(l_orderkey / 2000) AS BIGINT) AS STRING), '-', CAST(l_suppkey % 10 AS STRING))",
    "sequence": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "timestamp": "TIMESTAMP '2026-01-01 00:00:00' + (l_orderkey * 10 + l_linenumber) * INTERVAL '1' SECOND",
    "event_type": (
        "CASE WHEN l_linenumber % 3 = 0 THEN 'kill' WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 'round_start' "
        "ELSE 'tick' END"
    ),
    "victim_team": "CASE WHEN l_partkey % 2 = 0 THEN 'T' ELSE 'CT' END",
    "headshot": "l_quantity > 25",
}
for _name in ("kills_ct_window", "kills_t_window", "window_seconds"):
    del FEED[_name]
FEED_SPAN = 150.0

ROUND = {
    "match_id": "concat('m', CAST(o_orderkey AS STRING))",
    "round_number": "CAST(o_orderkey % 24 + 1 AS INT)",
    "winner": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CT' ELSE 'T' END",
    "reason": (
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE o_orderstatus "
        "WHEN 'F' THEN 't_eliminated' WHEN 'O' THEN 'bomb_defused' ELSE 'time_expired' END "
        "ELSE CASE o_orderstatus WHEN 'F' THEN 'ct_eliminated' ELSE 'bomb_exploded' END END"
    ),
}

# orders by customer: the rounds of one match, replayed whenever a number repeats.
CUSTOMER_ROUND = {
    "match_id": "o_custkey",
    "sequence": "o_orderkey",
    "round_number": "CAST(o_orderkey % 96 + 1 AS INT)",
    "winner": ROUND["winner"],
    "reason": ROUND["reason"],
    "score_ct": "CAST(o_orderkey % 13 AS INT)",
    "score_t": "CAST(o_orderkey % 11 AS INT)",
}

# documents with a quality label: the prediction grows with the text length.
SCORED_DOCUMENT = {
    "match_id": "doc_id",
    "ct_win_probability": "n_chars / (n_chars + CAST(2000 AS DOUBLE))",
}

PROBABILITY = (
    "0.5 + (alive_ct - alive_t) / CAST(20 AS DOUBLE) + (health_ct - health_t) / CAST(4000 AS DOUBLE)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bind(df: DataFrame, binding: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in binding.items()])


def projection(binding: dict[str, str], source: str) -> str:
    """The same binding as a SELECT for the checking engine."""
    columns = ", ".join(f"{text} AS {name}" for name, text in binding.items())
    return f"SELECT {columns} FROM {source}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(table(spark, sf_dir, "events"), EVENT)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(table(spark, sf_dir, "lineitem"), TICK)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(table(spark, sf_dir, "lineitem"), FEED)


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(table(spark, sf_dir, "orders"), ROUND)


def customer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(table(spark, sf_dir, "orders"), CUSTOMER_ROUND)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("ct_won"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = documents.join(labels, "doc_id")
    return joined.select(
        *[F.expr(text).alias(name) for name, text in SCORED_DOCUMENT.items()], "ct_won"
    )


# A snapshot per line: ten players whose values follow from the line's keys.
PLAYER_HEALTH = "greatest(0, (l_partkey * ({i} + 3) + l_linenumber * 17) % 131 - 30)"
PLAYER_MONEY = "(l_suppkey * ({i} + 1) * 37) % 16001"
PLAYER_WEAPON = "(l_partkey + {i}) % 16"


def _spread(lines: DataFrame) -> DataFrame:
    """The lines dealt to all cores: a file of few row groups is read by as few tasks, and rows made of a line are dear."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(max(4 * cores, lines.rdd.getNumPartitions()))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested snapshots (match_id, sequence, timestamp, state) from lineitem."""
    lines = table(spark, sf_dir, "lineitem")
    weapons = F.array(*[F.lit(w) for w in fv.WEAPON_COST])

    part, line, supplier = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")

    def player(i):
        health = F.greatest(F.lit(0), (part * (i + 3) + line * 17) % 131 - 30).cast("int")
        axis = (part % 4000 + i).cast("double")
        number = i.cast("string")
        return F.struct(
            F.concat(F.lit("p"), number).alias("player_id"),
            F.concat(F.lit("Player "), number).alias("name"),
            F.when(i < 5, "CT").otherwise("T").alias("team"),
            health.alias("health"),
            F.when(health > 50, 100).otherwise(0).alias("armour"),
            (health > 80).alias("has_helmet"),
            ((health > 90) & (i < 5)).alias("has_defuse_kit"),
            ((supplier * (i + 1) * 37) % 16001).cast("int").alias("money"),
            F.get(weapons, ((part + i) % 16).cast("int")).alias("primary_weapon"),
            F.struct(axis.alias("x"), (axis * 2).alias("y"), F.lit(0.0).alias("z")).alias(
                "position"
            ),
            (line % (i + 2)).cast("int").alias("kills"),
            (line % (i + 3)).cast("int").alias("deaths"),
            F.lit(0).alias("assists"),
            F.lit(0).alias("damage_dealt"),
        )

    def economy(side: str):
        low = side.lower()
        return F.struct(
            F.lit(side).alias("team"),
            F.expr(TICK[f"money_{low}"]).alias("money"),
            F.expr(TICK[f"equipment_{low}"]).alias("equipment_value"),
            F.expr(TICK[f"losses_{low}"]).alias("consecutive_losses"),
        )

    def tick(name: str):
        return F.expr(TICK[name])

    state = F.struct(
        tick("match_id").alias("match_id"),
        tick("map_name").alias("map_name"),
        tick("timestamp").alias("timestamp"),
        tick("score_ct").alias("score_ct"),
        tick("score_t").alias("score_t"),
        F.struct(
            tick("round_number").alias("round_number"),
            tick("phase").alias("phase"),
            tick("seconds_remaining").alias("seconds_remaining"),
            tick("bomb_planted").alias("bomb_planted"),
            tick("bomb_seconds").alias("bomb_seconds_remaining"),
        ).alias("round_state"),
        F.transform(F.array(*[F.lit(i) for i in range(10)]), player).alias("players"),
        economy("CT").alias("economy_ct"),
        economy("T").alias("economy_t"),
    )
    keyed = _spread(lines).withColumns({c: tick(c) for c in ("match_id", "sequence", "timestamp")})
    return once(keyed, {"state": state}).select("match_id", "sequence", "timestamp", "state")
