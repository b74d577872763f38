"""Queries over the benchmark tables, one per operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundcast.functions import display, scoring, snapshot
from roundcast.functions import fixed_values as fv
from roundcast.functions.features import feature_frame, live, scoreable, situation_tags, situations
from roundcast.functions.numeric import micros
from roundcast.operators import drift as dr
from roundcast.operators import evaluate as ev
from roundcast.operators import labels as lb
from roundcast.operators import live as lv
from roundcast.operators import momentum as mo
from roundcast.operators import summary as sm
from roundcast.plans import bindings as b
from roundcast.plans.bindings import EVENT, MOMENTUM_SPAN, PROBABILITY, TICK, projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


# --- shared SQL pieces -----------------------------------------------------------
_TIE = [c for c in TICK if c not in ("match_id", "sequence")]
_TIE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in _TIE)
TICKS_SQL = f"ticks AS ({projection(TICK, 'lineitem')})"
DEDUPED_SQL = f"""{TICKS_SQL}, deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, sequence ORDER BY {_TIE_ORDER}) AS rn
    FROM ticks) WHERE rn = 1)"""
ROUNDS_SQL = f"rounds AS ({projection(b.ROUND, 'orders')})"
LABELLED_SQL = f"""{DEDUPED_SQL}, {ROUNDS_SQL}, labelled AS (
  SELECT deduped.*, rounds.winner AS round_winner, rounds.reason AS round_reason,
    CAST(rounds.winner = 'CT' AS INTEGER) AS ct_won
  FROM deduped JOIN rounds USING (match_id, round_number) WHERE phase <> 'freezetime')"""
EVENTS_SQL = f"ev AS ({projection(EVENT, 'events')})"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_ticks(lb.dedupe(b.ticks(spark, sf_dir)), b.rounds(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).withColumn("ct_win_probability", F.expr(PROBABILITY))


# --- history and labels ------------------------------------------------------------
_SHORT = [
    "match_id", "sequence", "round_number", "phase", "alive_ct", "alive_t", "money_ct",
    "equipment_t", "seconds_remaining", "round_winner", "round_reason", "ct_won",
]


@query(f"WITH {LABELLED_SQL} SELECT {', '.join(_SHORT)} FROM labelled")
def label_training_rows(spark, sf_dir):
    return lb.training_frame(_labelled(spark, sf_dir).select(*_SHORT))


@query(
    f"WITH {LABELLED_SQL} SELECT CAST(coalesce(sum(ct_won), 0) AS BIGINT) AS ct_rows, "
    "CAST(count(*) - coalesce(sum(ct_won), 0) AS BIGINT) AS t_rows FROM labelled"
)
def label_balance(spark, sf_dir):
    return lb.label_balance(_labelled(spark, sf_dir))


_SITUATION_SQL = {
    "early round": "seconds_remaining > 80",
    "mid round": "seconds_remaining > 30 AND seconds_remaining <= 80",
    "late round": "seconds_remaining <= 30 AND NOT bomb_planted",
    "post-plant": "bomb_planted",
    "even manpower": "alive_ct = alive_t",
    "ct ahead": "alive_ct > alive_t",
    "t ahead": "alive_ct < alive_t",
    "lopsided": "abs(alive_ct - alive_t) >= 3",
    "clutch": "alive_ct <= 1 OR alive_t <= 1",
    "full buy": "equipment_ct > 20000 AND equipment_t > 20000",
    "eco round": "equipment_ct < 10000 OR equipment_t < 10000",
}
_TAGGED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, * FROM scored WHERE {text}" for name, text in _SITUATION_SQL.items()
)
SCORED_SQL = (
    f"{LABELLED_SQL}, scored AS (SELECT *, {PROBABILITY} AS ct_win_probability FROM labelled), "
    f"tagged AS ({_TAGGED_SQL} UNION ALL SELECT 'overall' AS name, * FROM scored)"
)


@query(
    f"WITH {SCORED_SQL} SELECT name, CAST(sum(ct_won) AS BIGINT) AS ct_rows, "
    "CAST(count(*) - sum(ct_won) AS BIGINT) AS t_rows, "
    "round(avg(alive_ct - alive_t), 6) AS mean_advantage FROM tagged GROUP BY name"
)
def situation_label_balance(spark, sf_dir):
    """Flagship: label balance and man advantage by situation, from raw ticks."""
    tags = F.explode(situation_tags(situations(), "overall")).alias("name")
    tagged = _labelled(spark, sf_dir).select(tags, "ct_won", "alive_ct", "alive_t")
    won = F.sum("ct_won")
    return tagged.groupBy("name").agg(
        won.cast("long").alias("ct_rows"),
        (F.count(F.lit(1)) - won).cast("long").alias("t_rows"),
        F.round(F.avg(F.col("alive_ct") - F.col("alive_t")), 6).alias("mean_advantage"),
    )


@query(
    f"WITH {DEDUPED_SQL} SELECT match_id, sequence, map_name, score_ct, equipment_ct, "
    "window_seconds FROM deduped"
)
def dedupe_replays(spark, sf_dir):
    return lb.dedupe(b.ticks(spark, sf_dir)).select(
        "match_id", "sequence", "map_name", "score_ct", "equipment_ct", "window_seconds"
    )


_CUSTOMER_ROUNDS_SQL = f"cr AS ({projection(b.CUSTOMER_ROUND, 'orders')})"
_ROUND_ONCE_SQL = f"""{_CUSTOMER_ROUNDS_SQL}, once AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY match_id, round_number ORDER BY sequence DESC) AS rn FROM cr) WHERE rn = 1)"""


@query(f"WITH {_ROUND_ONCE_SQL} SELECT * FROM once")
def upsert_rounds(spark, sf_dir):
    return lb.upsert(
        b.customer_rounds(spark, sf_dir),
        ["match_id", "round_number"],
        ["sequence"],
    )


@query(
    f"""WITH {_CUSTOMER_ROUNDS_SQL} SELECT match_id, winner, score_ct, score_t, sequence FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY sequence DESC) AS rn FROM cr)
    WHERE rn = 1"""
)
def upsert_matches(spark, sf_dir):
    return lb.upsert(
        b.customer_rounds(spark, sf_dir),
        ["match_id"],
        ["sequence"],
        ["winner", "score_ct", "score_t", "sequence"],
    )


@query(
    """WITH ids AS (SELECT DISTINCT concat('m', CAST(l_orderkey AS STRING)) AS match_id FROM lineitem),
    ranked AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS rk, count(*) OVER () AS n FROM ids),
    side AS (SELECT match_id, CASE WHEN rk > n - greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0))
      THEN 'test' ELSE 'train' END AS split FROM ranked)
    SELECT split, CAST(count(*) AS BIGINT) AS split_rows,
      CAST(count(DISTINCT match_id) AS BIGINT) AS matches,
      min(match_id) AS first_match, max(match_id) AS last_match
    FROM lineitem l JOIN side ON side.match_id = concat('m', CAST(l.l_orderkey AS STRING)) GROUP BY split"""
)
def split_by_match(spark, sf_dir):
    train, test = lb.split_by_match(b.ticks(spark, sf_dir).select("match_id"))
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("split_rows"),
        F.count_distinct("match_id").alias("matches"),
        F.min("match_id").alias("first_match"),
        F.max("match_id").alias("last_match"),
    )


@query(
    f"""WITH {_CUSTOMER_ROUNDS_SQL} SELECT match_id, sequence, winner FROM cr WHERE match_id NOT IN
    (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def drop_matches(spark, sf_dir):
    gone = b.table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    rounds = b.customer_rounds(spark, sf_dir).select("match_id", "sequence", "winner")
    return lb.drop_matches(rounds, gone.select(F.col("c_custkey").alias("match_id")))


# --- momentum ------------------------------------------------------------------------
def _epoch_sql(events_sql):
    return f"""{events_sql}, ep AS (SELECT *, CAST(epoch_us(timestamp) AS BIGINT) AS us,
  sum(CASE WHEN event_type = 'round_start' THEN 1 ELSE 0 END)
    OVER (PARTITION BY match_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS epoch FROM ev)"""


def _momentum_sql(events_sql, span_seconds):
    span_us = int(span_seconds * 1_000_000)
    return f"""{_epoch_sql(events_sql)}, kw AS (
  SELECT match_id, sequence, epoch,
    sum(CASE WHEN victim_team = 'T' THEN 1 ELSE 0 END) OVER w AS kills_ct,
    sum(CASE WHEN victim_team = 'T' THEN 0 ELSE 1 END) OVER w AS kills_t,
    sum(CASE WHEN headshot THEN 1 ELSE 0 END) OVER w AS headshots,
    us - min(us) OVER w AS kill_span
  FROM ep WHERE event_type = 'kill'
  WINDOW w AS (PARTITION BY match_id, epoch ORDER BY us
               RANGE BETWEEN {span_us} PRECEDING AND CURRENT ROW)),
tw AS (
  SELECT match_id, sequence, epoch, count(*) OVER w AS ticks, us - min(us) OVER w AS tick_span
  FROM ep WHERE event_type = 'tick'
  WINDOW w AS (PARTITION BY match_id, epoch ORDER BY us
               RANGE BETWEEN {span_us} PRECEDING AND CURRENT ROW)),
mixed AS (
  SELECT match_id, sequence, epoch, 'kill' AS kind, kills_ct, kills_t, headshots, kill_span,
         NULL AS ticks, NULL AS tick_span FROM kw
  UNION ALL SELECT match_id, sequence, epoch, 'tick', NULL, NULL, NULL, NULL, ticks, tick_span FROM tw),
seen AS (
  SELECT match_id, sequence, epoch, kind, ticks, tick_span,
    coalesce(last_value(kills_ct IGNORE NULLS) OVER w, 0) AS kills_ct,
    coalesce(last_value(kills_t IGNORE NULLS) OVER w, 0) AS kills_t,
    coalesce(last_value(headshots IGNORE NULLS) OVER w, 0) AS headshots,
    coalesce(last_value(kill_span IGNORE NULLS) OVER w, 0) AS kill_span
  FROM mixed WINDOW w AS (PARTITION BY match_id, epoch ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
momentum AS (
  SELECT match_id, sequence, CAST(epoch AS BIGINT) AS epoch, CAST(kills_ct AS BIGINT) AS kills_ct,
    CAST(kills_t AS BIGINT) AS kills_t, CAST(headshots AS BIGINT) AS headshots,
    CAST(ticks AS BIGINT) AS ticks,
    CAST(greatest(tick_span, kill_span) AS DOUBLE) / 1000000 AS window_seconds
  FROM seen WHERE kind = 'tick')"""


_SPAN_US = int(MOMENTUM_SPAN * 1_000_000)
_EPOCH_SQL = _epoch_sql(EVENTS_SQL)
_MOMENTUM_SQL = _momentum_sql(EVENTS_SQL, MOMENTUM_SPAN)


def _momentum(spark, sf_dir, keep=()):
    return mo.momentum(b.events(spark, sf_dir), span_seconds=MOMENTUM_SPAN, keep=keep)


@query(f"WITH {_MOMENTUM_SQL} SELECT * FROM momentum")
def momentum_windows(spark, sf_dir):
    return _momentum(spark, sf_dir)


@query(
    f"""WITH {_MOMENTUM_SQL} SELECT match_id, sequence, kills_ct - kills_t AS kill_delta,
    kills_ct + kills_t AS total_kills,
    CASE WHEN window_seconds > 0 THEN (kills_ct + kills_t) / window_seconds ELSE 0 END AS kills_per_second,
    CASE WHEN kills_ct + kills_t > 0 THEN CAST(headshots AS DOUBLE) / (kills_ct + kills_t) ELSE 0 END
      AS headshot_rate, window_seconds FROM momentum"""
)
def momentum_metrics(spark, sf_dir):
    columns = scoring.momentum_columns(
        *[F.col(c) for c in ("kills_ct", "kills_t", "headshots", "window_seconds")]
    )
    return _momentum(spark, sf_dir).select("match_id", "sequence", *columns)


@query(
    f"WITH {_EPOCH_SQL} SELECT match_id, sequence, event_type, CAST(epoch AS BIGINT) AS epoch FROM ep"
)
def epoch_reset(spark, sf_dir):
    return mo.epochs(b.events(spark, sf_dir).select("match_id", "sequence", "event_type"))


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, coalesce(last_value(
      CASE WHEN event_type IN ('round_start', 'tick') THEN round_number END IGNORE NULLS)
      OVER (PARTITION BY match_id ORDER BY sequence ROWS UNBOUNDED PRECEDING), 0) AS current_round FROM ev"""
)
def current_round(spark, sf_dir):
    out = mo.current_round(
        b.events(spark, sf_dir).select("match_id", "sequence", "event_type", "round_number")
    )
    return out.select(
        "match_id", "sequence", F.coalesce("current_round", F.lit(0)).alias("current_round")
    )


@query(
    f"""WITH {EVENTS_SQL}, us AS (SELECT *, CAST(epoch_us(timestamp) AS BIGINT) AS us FROM ev)
    SELECT match_id, sequence, CAST(count(*) OVER w AS BIGINT) AS items,
      CAST(us - min(us) OVER w AS DOUBLE) / 1000000 AS span_seconds
    FROM us WINDOW w AS (PARTITION BY match_id ORDER BY us
      RANGE BETWEEN {_SPAN_US} PRECEDING AND CURRENT ROW)"""
)
def tick_window_span(spark, sf_dir):
    from roundcast.operators.scan import ranked, trailing_range

    rows = b.events(spark, sf_dir).select(
        "match_id", "sequence", micros(F.col("timestamp")).alias("us")
    )
    placed = ranked(rows, ["match_id"], "sequence", "place")
    one = F.lit(1).cast("long")
    out = trailing_range(
        placed,
        ["match_id"],
        "us",
        "sequence",
        _SPAN_US,
        {"items": ("place", one)},
        block=_SPAN_US // 512,
    )
    return out.select(
        "match_id",
        "sequence",
        "items",
        ((F.col("us") - F.col("oldest")) / 1_000_000.0).alias("span_seconds"),
    )


# --- snapshots -------------------------------------------------------------------------
def _health_sql(i):
    return "(" + b.PLAYER_HEALTH.format(i=i) + ")"


_ALIVE_CT_SQL = " + ".join(f"CAST({_health_sql(i)} > 0 AS INT)" for i in range(5))
_ALIVE_T_SQL = " + ".join(f"CAST({_health_sql(i)} > 0 AS INT)" for i in range(5, 10))
_HEALTH_CT_SQL = " + ".join(_health_sql(i) for i in range(5))
_HEALTH_T_SQL = " + ".join(_health_sql(i) for i in range(5, 10))
_FLAT_PLAIN = [
    "map_name", "round_number", "phase", "seconds_remaining", "bomb_planted", "score_ct",
    "score_t", "money_ct", "money_t", "equipment_ct", "equipment_t", "losses_ct", "losses_t",
]


@query(
    "SELECT "
    + ", ".join(f"{TICK[c]} AS {c}" for c in ["match_id", "sequence", *_FLAT_PLAIN])
    + f", coalesce({TICK['bomb_seconds']}, -1) AS bomb_seconds"
    + f", CAST({_ALIVE_CT_SQL} AS INT) AS alive_ct, CAST({_ALIVE_T_SQL} AS INT) AS alive_t"
    + f", CAST({_HEALTH_CT_SQL} AS INT) AS health_ct, CAST({_HEALTH_T_SQL} AS INT) AS health_t"
    + " FROM lineitem"
)
def flatten_nested(spark, sf_dir):
    flat = b.snapshots(spark, sf_dir).select(
        "match_id", "sequence", *snapshot.tick_columns(F.col("state"))
    )
    return flat.withColumn("bomb_seconds", F.coalesce("bomb_seconds", F.lit(-1.0)))


@query(
    f"""SELECT {TICK['match_id']} AS match_id, {TICK['sequence']} AS sequence, 'CT' AS team,
      CAST({_ALIVE_CT_SQL} AS INT) AS alive, CAST({_HEALTH_CT_SQL} AS INT) AS health,
      {TICK['money_ct']} AS money, {TICK['equipment_ct']} AS equipment_value,
      {TICK['losses_ct']} AS consecutive_losses,
      CAST({_ALIVE_CT_SQL} - ({_ALIVE_T_SQL}) AS INT) AS man_advantage FROM lineitem
    UNION ALL SELECT {TICK['match_id']}, {TICK['sequence']}, 'T', CAST({_ALIVE_T_SQL} AS INT),
      CAST({_HEALTH_T_SQL} AS INT), {TICK['money_t']}, {TICK['equipment_t']}, {TICK['losses_t']},
      CAST({_ALIVE_CT_SQL} - ({_ALIVE_T_SQL}) AS INT) FROM lineitem"""
)
def team_summary(spark, sf_dir):
    state = F.col("state")
    sides = F.array(
        *[
            F.struct(F.lit(t).alias("team"), snapshot.team_summary(state, t).alias("s"))
            for t in fv.TEAMS
        ]
    )
    return b.snapshots(spark, sf_dir).select(
        "match_id",
        "sequence",
        snapshot.man_advantage(F.col("state.players")).alias("man_advantage"),
        F.explode(sides).alias("side"),
    ).select("match_id", "sequence", "side.team", "side.s.*", "man_advantage")


_WEAPONS_SQL = "[" + ", ".join(f"'{w}'" for w in fv.WEAPON_COST) + "]"
_PLAYERS_SQL = " UNION ALL ".join(
    f"""SELECT {TICK['match_id']} AS match_id, {TICK['sequence']} AS sequence, {i} AS position,
      l_partkey, l_suppkey, l_linenumber, 'p{i}' AS player_id,
      '{'CT' if i < 5 else 'T'}' AS team, CAST({_health_sql(i)} AS INT) AS health,
      CAST({b.PLAYER_MONEY.format(i=i)} AS INT) AS money,
      {_WEAPONS_SQL}[{b.PLAYER_WEAPON.format(i=i)} + 1] AS weapon FROM lineitem"""
    for i in range(10)
)


@query(
    f"""WITH p AS ({_PLAYERS_SQL}) SELECT match_id, sequence, position, player_id, team,
      health, money, weapon, health > 0 AS alive, CAST(l_linenumber % (position + 2) AS INT) AS kills,
      round(sqrt(CAST(5 AS DOUBLE) * (l_partkey % 4000 + position) * (l_partkey % 4000 + position)), 3)
        AS from_origin FROM p"""
)
def player_rows(spark, sf_dir):
    from roundcast.functions.numeric import distance

    origin = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
    rows = b.snapshots(spark, sf_dir).select(
        "match_id", "sequence", F.posexplode("state.players").alias("position", "p")
    )
    return rows.select(
        "match_id",
        "sequence",
        "position",
        *snapshot.player_row(F.col("p")),
        F.round(distance(F.col("p.position"), origin), 3).alias("from_origin"),
    ).drop("name", "armour", "deaths")


# --- features ----------------------------------------------------------------------------
def _ratio_sql(a, c):
    return (
        f"CASE WHEN {a} + {c} > 0 THEN CAST({a} - {c} AS DOUBLE) / ({a} + {c}) ELSE 0 END"
    )


def _clamp_sql(x, low, high):
    return f"greatest({low}, least({high}, {x}))"


_D = "CAST({} AS DOUBLE)".format
_FEATURE_SQL = {
    "alive_ct": f"{_D('alive_ct')} / 5",
    "alive_t": f"{_D('alive_t')} / 5",
    "alive_delta": _clamp_sql(f"{_D('alive_ct - alive_t')} / 5", -1, 1),
    "alive_ratio": _ratio_sql("alive_ct", "alive_t"),
    "health_ratio": _ratio_sql("health_ct", "health_t"),
    "time_fraction": _clamp_sql("seconds_remaining / 115", 0, 1),
    "bomb_planted": _D("bomb_planted"),
    "bomb_time_fraction": _clamp_sql("coalesce(bomb_seconds, 0) / 40", 0, 1),
    "money_ratio": _ratio_sql("money_ct", "money_t"),
    "equipment_ratio": _ratio_sql("equipment_ct", "equipment_t"),
    "loss_streak_delta": _clamp_sql(f"{_D('losses_ct - losses_t')} / 5", -1, 1),
    "score_delta": _clamp_sql(f"{_D('score_ct - score_t')} / 13", -1, 1),
    "round_fraction": _clamp_sql(f"{_D('score_ct + score_t')} / 24", 0, 1),
    "kill_delta_window": _clamp_sql(f"{_D('kills_ct_window - kills_t_window')} / 5", -1, 1),
    "engagement_pace": _clamp_sql(
        "CASE WHEN window_seconds > 0 THEN (kills_ct_window + kills_t_window) / window_seconds ELSE 0 END",
        0,
        1,
    ),
}
FEATURES_SQL = "SELECT match_id, sequence, ct_won, " + ", ".join(
    f"CAST({text} AS DOUBLE) AS {name}" for name, text in _FEATURE_SQL.items()
) + " FROM labelled"


def _features(spark, sf_dir):
    return feature_frame(_labelled(spark, sf_dir), ["match_id", "sequence", "ct_won"])


@query(f"WITH {LABELLED_SQL} {FEATURES_SQL}")
def feature_frame_rows(spark, sf_dir):
    return _features(spark, sf_dir)


_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feats" for f in fv.FEATURES
)


@query(
    f"WITH {LABELLED_SQL}, feats AS ({FEATURES_SQL}), long AS ({_LONG_SQL}) "
    "SELECT feature, round(min(value), 6) AS min, round(max(value), 6) AS max, "
    "round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY feature"
)
def describe_features(spark, sf_dir):
    out = sm.describe_features(_features(spark, sf_dir))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


_STATS_SQL = ", ".join(f"avg({f}) AS mean_{f}, stddev_samp({f}) AS std_{f}" for f in fv.FEATURES)
_FAR_SQL = " + ".join(
    f"CASE WHEN s.std_{f} > 1e-9 THEN least(1, abs(f.{f} - s.mean_{f}) / s.std_{f} / 3) ELSE 0 END"
    for f in fv.FEATURES
)
_COUNTED_SQL = " + ".join(f"CASE WHEN s.std_{f} > 1e-9 THEN 1 ELSE 0 END" for f in fv.FEATURES)


@query(
    f"WITH {LABELLED_SQL}, feats AS ({FEATURES_SQL}) SELECT "
    + ", ".join(
        f"round(avg({f}), 6) AS mean_{f}, round(stddev_samp({f}), 6) AS std_{f}" for f in fv.FEATURES
    )
    + " FROM feats"
)
def support_fit(spark, sf_dir):
    fitted = sm.fit_support(_features(spark, sf_dir))
    return fitted.select(*[F.round(c, 6).alias(c) for c in fitted.columns])


@query(
    f"WITH {LABELLED_SQL}, feats AS ({FEATURES_SQL}), s AS (SELECT {_STATS_SQL} FROM feats) "
    f"SELECT f.match_id, f.sequence, round(greatest(0, 1 - ({_FAR_SQL}) / ({_COUNTED_SQL})), 6) "
    "AS support FROM feats f CROSS JOIN s"
)
def support_score(spark, sf_dir):
    features = _features(spark, sf_dir)
    scored = sm.support_score(features, sm.fit_support(features))
    return scored.select("match_id", "sequence", F.round("support", 6).alias("support"))


# --- evaluation ---------------------------------------------------------------------------
_EPS = "2.220446049250313e-16"
_METRICS_SQL = f"""SELECT name, CAST(count(*) AS BIGINT) AS count,
  round(avg(-(ct_won * ln(greatest({_EPS}, least(1 - {_EPS}, p))) +
    (1 - ct_won) * ln(1 - greatest({_EPS}, least(1 - {_EPS}, p))))), 6) AS log_loss,
  round(avg((p - ct_won) * (p - ct_won)), 6) AS brier_score,
  round(CASE WHEN sum(ct_won) > 0 AND sum(1 - ct_won) > 0 THEN
    (sum(CASE WHEN ct_won = 1 THEN rk ELSE 0 END) - sum(ct_won) * (sum(ct_won) + 1) / 2.0)
    / (CAST(sum(ct_won) AS DOUBLE) * sum(1 - ct_won)) ELSE 0.5 END, 6) AS roc_auc,
  round(avg(CASE WHEN (p >= 0.5) = (ct_won = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CAST(ct_won AS DOUBLE)), 6) AS base_rate FROM (
    SELECT name, ct_won, ct_win_probability AS p,
      rank() OVER (PARTITION BY name ORDER BY ct_win_probability)
      + (count(*) OVER (PARTITION BY name, ct_win_probability) - 1) / 2.0 AS rk
    FROM tagged) GROUP BY name"""
_SKILL_SQL = f"""metrics AS ({_METRICS_SQL.replace("round(avg(-(", "(avg(-(").replace(", 6) AS log_loss", ") AS log_loss").replace("round(avg(CAST(ct_won AS DOUBLE)), 6) AS base_rate", "avg(CAST(ct_won AS DOUBLE)) AS base_rate")}),
skilled AS (SELECT *, 1 - log_loss / -(base_rate * ln(base_rate) + (1 - base_rate) * ln(1 - base_rate))
  AS skill_score FROM metrics)"""


def _rounded(df, *columns):
    return df.select(
        *[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


_METRIC_NAMES = ("log_loss", "brier_score", "roc_auc", "accuracy", "base_rate", "skill_score")


def _benchmark(spark, sf_dir):
    return ev.benchmark_by_situation(_scored(spark, sf_dir), situations())


@query(
    f"""WITH {SCORED_SQL}, {_SKILL_SQL} SELECT name, count, round(log_loss, 6) AS log_loss,
    brier_score, roc_auc, accuracy, round(base_rate, 6) AS base_rate, round(skill_score, 6) AS skill_score
    FROM skilled WHERE name = 'overall' OR (count >= 50 AND base_rate > 0 AND base_rate < 1)"""
)
def benchmark_by_situation(spark, sf_dir):
    return _rounded(_benchmark(spark, sf_dir).drop("baseline_log_loss"), *_METRIC_NAMES)


@query(
    f"""WITH {SCORED_SQL}, {_SKILL_SQL} SELECT name, round(skill_score, 6) AS skill_score FROM skilled
    WHERE name <> 'overall' AND count >= 50 AND base_rate > 0 AND base_rate < 1 AND skill_score <= 0"""
)
def failing_slices(spark, sf_dir):
    failing = ev.failing_slices(_benchmark(spark, sf_dir))
    return _rounded(failing.select("name", "skill_score"), "skill_score")


@query(
    f"""WITH {SCORED_SQL}, {_SKILL_SQL} SELECT name, round(skill_score, 6) AS skill_score FROM skilled
    WHERE name <> 'overall' AND count >= 50 AND base_rate > 0 AND base_rate < 1
    ORDER BY skill_score, name LIMIT 1"""
)
def weakest_slice(spark, sf_dir):
    return _rounded(ev.weakest_slice(_benchmark(spark, sf_dir)), "skill_score")


@query(
    f"""WITH {SCORED_SQL}, {_SKILL_SQL} SELECT name, round(skill_score, 6) AS skill_score FROM skilled
    WHERE name <> 'overall' AND count >= 50 AND base_rate > 0 AND base_rate < 1"""
)
def slices_by_skill(spark, sf_dir):
    ordered = ev.slices_by_skill(_benchmark(spark, sf_dir))
    return _rounded(ordered.select("name", "skill_score"), "skill_score")


_DOCS_SQL = f"""docs AS (SELECT d.doc_id AS match_id,
  {b.SCORED_DOCUMENT['ct_win_probability']} AS p, l.quality AS ct_won
  FROM documents d JOIN labels l USING (doc_id))"""


@query(
    f"""WITH {_DOCS_SQL}, tagged AS (SELECT 'all' AS name, ct_won, p AS ct_win_probability FROM docs),
    {_SKILL_SQL} SELECT count, round(log_loss, 6) AS log_loss, brier_score, roc_auc, accuracy,
    round(base_rate, 6) AS base_rate, round(skill_score, 6) AS skill_score FROM skilled"""
)
def evaluate_overall(spark, sf_dir):
    metrics = ev.evaluate(b.scored_documents(spark, sf_dir)).drop("baseline_log_loss")
    return _rounded(metrics, *_METRIC_NAMES)


_BINS_SQL = f"""{_DOCS_SQL}, binned AS (SELECT p, ct_won, CAST(CASE WHEN p = 1 THEN 9 ELSE
    {' + '.join(f'CAST(p >= {i} * CAST(0.1 AS DOUBLE) AS INT)' for i in range(1, 10))} END AS INT) AS bin FROM docs),
  bins AS (SELECT bin, CAST(count(*) AS BIGINT) AS count, avg(p) AS mean_predicted,
    avg(CAST(ct_won AS DOUBLE)) AS observed_rate FROM binned GROUP BY bin)"""


@query(
    f"""WITH {_BINS_SQL} SELECT bin, concat(CAST(bin * 10 AS STRING), '%-', CAST((bin + 1) * 10 AS STRING), '%')
    AS label, count, CAST(sum(count) OVER () AS BIGINT) AS total, round(mean_predicted, 6) AS mean_predicted,
    round(observed_rate, 6) AS observed_rate, round(mean_predicted - observed_rate, 6) AS error,
    abs(mean_predicted - observed_rate) >= 0.05 AS flagged FROM bins"""
)
def calibration_bins(spark, sf_dir):
    bins = ev.calibration_bins(b.scored_documents(spark, sf_dir))
    return _rounded(bins, "mean_predicted", "observed_rate", "error")


@query(
    f"""WITH {_BINS_SQL} SELECT
    round(sum(count * abs(mean_predicted - observed_rate)) / sum(count), 6) AS expected_calibration_error,
    round(max(abs(mean_predicted - observed_rate)), 6) AS max_calibration_error,
    sum(count * abs(mean_predicted - observed_rate)) / sum(count) < 0.05 AS is_well_calibrated FROM bins"""
)
def calibration_error(spark, sf_dir):
    report = ev.calibration_error(ev.calibration_bins(b.scored_documents(spark, sf_dir)))
    return _rounded(report, "expected_calibration_error", "max_calibration_error")


_POINTS = ((0.0, 0.05), (0.1, 0.2), (0.35, 0.3), (0.6, 0.72), (0.9, 0.8), (1.0, 0.97))
_INTERP_SQL = " ".join(
    f"WHEN p <= CAST({x1} AS DOUBLE) THEN CAST({y0} AS DOUBLE) + "
    f"(CAST({y1} AS DOUBLE) - {y0}) / (CAST({x1} AS DOUBLE) - {x0}) * (p - {x0})"
    for (x0, y0), (x1, y1) in zip(_POINTS, _POINTS[1:])
)


@query(
    f"WITH {_DOCS_SQL} SELECT match_id, round(CASE {_INTERP_SQL} END, 6) AS calibrated FROM docs"
)
def calibrate_apply(spark, sf_dir):
    from roundcast.operators.calibrator import apply_calibrator

    xs, ys = zip(*_POINTS)
    out = apply_calibrator(b.scored_documents(spark, sf_dir), (xs, ys), "ct_win_probability")
    return out.select("match_id", F.round("calibrated", 6).alias("calibrated"))


# --- drift -----------------------------------------------------------------------------
_DRIFT_COLUMNS = ["quantity", "price", "discount", "tax", "line", "returned"]
_DRIFT_BIND = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "returned": "CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
}
_DRIFT_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, l_shipdate < TIMESTAMP '1998-06-01 00:00:00' AS old, "
    f"CAST({text} AS DOUBLE) AS v FROM lineitem"
    for c, text in _DRIFT_BIND.items()
)
_DRIFT_SQL = f"""lg AS ({_DRIFT_LONG}),
q AS (SELECT feature, unnest(quantile_cont(v, [{', '.join(f'{i / 10}' for i in range(11))}])) AS e
      FROM lg WHERE old GROUP BY feature),
edges AS (SELECT feature, list(DISTINCT e ORDER BY e) AS es FROM q GROUP BY feature),
binned AS (SELECT lg.feature, old, len(es) AS n_edges,
  len(list_filter(es[2:len(es) - 1], lambda x: x <= v)) AS bin, count(*) AS n
  FROM lg JOIN edges USING (feature) GROUP BY ALL),
stats AS (SELECT feature, count(*) FILTER (old) AS rn, count(*) FILTER (NOT old) AS ln,
  count(DISTINCT v) FILTER (old) AS rd, count(DISTINCT v) FILTER (NOT old) AS ld,
  avg(v) FILTER (old) AS rm, avg(v) FILTER (NOT old) AS lm, stddev_pop(v) FILTER (old) AS rs,
  stddev_pop(v) FILTER (NOT old) AS ls FROM lg GROUP BY feature),
shares AS (SELECT feature, bin, n_edges,
  greatest(coalesce(sum(n) FILTER (old), 0) / any_value(rn), 1e-6) AS r,
  greatest(coalesce(sum(n) FILTER (NOT old), 0) / any_value(ln), 1e-6) AS s
  FROM binned JOIN stats USING (feature) GROUP BY feature, bin, n_edges),
psi AS (SELECT feature, sum((s - r) * ln(s / r)) AS psi FROM shares GROUP BY feature),
report AS (SELECT feature, psi, CASE WHEN rs < 1e-6 THEN 0 ELSE (lm - rm) / rs END AS mean_shift_sigma,
  rm AS reference_mean, lm AS live_mean,
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'severe' END AS severity,
  NOT (ld < 30 AND NOT rd > 2 * ld) AS well_sampled, CAST(ln AS BIGINT) AS sample_count
  FROM psi JOIN stats USING (feature))"""


def _drift_sides(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    columns = [F.expr(text).alias(c) for c, text in _DRIFT_BIND.items()]
    return lines.filter(old).select(*columns), lines.filter(~old).select(*columns)


@query(f"WITH {_DRIFT_SQL} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_by_feature(spark, sf_dir):
    old, new = _drift_sides(spark, sf_dir)
    index = dr.stability_index(
        dr.value_counts(old, _DRIFT_COLUMNS), dr.value_counts(new, _DRIFT_COLUMNS)
    )
    return index.select("feature", F.round("psi", 6).alias("psi"))


@query(
    f"""WITH {_DRIFT_SQL} SELECT feature, round(psi, 6) AS psi,
    round(mean_shift_sigma, 5) AS mean_shift_sigma, round(reference_mean, 4) AS reference_mean,
    round(live_mean, 4) AS live_mean, severity, well_sampled, sample_count FROM report"""
)
def drift_report(spark, sf_dir):
    report = dr.drift_report(*_drift_sides(spark, sf_dir), columns=_DRIFT_COLUMNS)
    return report.select(
        "feature",
        F.round("psi", 6).alias("psi"),
        F.round("mean_shift_sigma", 5).alias("mean_shift_sigma"),
        F.round("reference_mean", 4).alias("reference_mean"),
        F.round("live_mean", 4).alias("live_mean"),
        "severity",
        "well_sampled",
        "sample_count",
    )


@query(
    f"""WITH {_DRIFT_SQL} SELECT CASE WHEN count(*) FILTER (well_sampled) = 0 THEN 'unknown'
      WHEN count(*) FILTER (well_sampled AND severity = 'severe') > 0 THEN 'severe'
      WHEN count(*) FILTER (well_sampled AND severity = 'moderate') > 0 THEN 'moderate'
      ELSE 'stable' END AS severity, round(max(psi), 6) AS max_psi,
      CAST(count(*) FILTER (well_sampled AND severity <> 'stable') AS BIGINT) AS drifted,
      min(sample_count) AS sample_count,
      count(*) FILTER (well_sampled AND severity = 'severe') > 0 AS should_retrain FROM report"""
)
def drift_verdict(spark, sf_dir):
    report = dr.drift_report(*_drift_sides(spark, sf_dir), columns=_DRIFT_COLUMNS)
    out = dr.drift_verdict(report).drop("worst_feature")
    return out.withColumn("max_psi", F.round("max_psi", 6))


# lines of cheap and of dear pieces, which differ in price and in quantity
_MOVED_SQL = _DRIFT_SQL.replace("l_shipdate < TIMESTAMP '1998-06-01 00:00:00'", "l_extendedprice < l_quantity * 2000")


@query(
    f"""WITH {_MOVED_SQL} SELECT CAST(row_number() OVER (ORDER BY psi DESC, feature) AS INTEGER) AS place, feature,
    round(psi, 6) AS psi, severity FROM report WHERE well_sampled AND severity <> 'stable'"""
)
def worst_drift_first(spark, sf_dir):
    """Features that moved between two sides and are sampled well enough, in the order of how far."""
    lines = b.table(spark, sf_dir, "lineitem")
    columns = [F.expr(text).alias(c) for c, text in _DRIFT_BIND.items()]
    old, new = (lines.filter(side).select(*columns) for side in ("l_extendedprice < l_quantity * 2000", "l_extendedprice >= l_quantity * 2000"))
    moved = dr.drifted_features(dr.drift_report(old, new, columns=_DRIFT_COLUMNS))
    # a row for each feature at most
    place = F.row_number().over(Window.orderBy(F.col("psi").desc(), "feature"))
    return moved.select(place.alias("place"), "feature", F.round("psi", 6).alias("psi"), "severity")


_QUANT_SQL = ", ".join(
    f"round(quantile_cont(v, {i / 10}), 4) AS q{i * 10}" for i in range(11)
)


@query(f"WITH lg AS ({_DRIFT_LONG}) SELECT feature, {_QUANT_SQL} FROM lg WHERE old GROUP BY feature")
def reference_quantiles(spark, sf_dir):
    old, _ = _drift_sides(spark, sf_dir)
    out = dr.exact_quantiles(dr.value_counts(old, _DRIFT_COLUMNS), [i / 10 for i in range(11)])
    return out.select(
        "feature", *[F.round(F.get("quantiles", F.lit(i)), 4).alias(f"q{i * 10}") for i in range(11)]
    )


@query(
    f"SELECT CAST(least(20000, count(*)) AS BIGINT) AS sampled, count(*) <= 20000 AS whole FROM lineitem"
)
def reference_sample(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    taken = dr.reference_sample(lines, key)
    total = lines.select(F.count(F.lit(1))).scalar()
    return taken.agg(F.count(F.lit(1)).alias("sampled")).withColumn("whole", total <= 20_000)


# --- predictions and confidence ------------------------------------------------------------
@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, probability AS ct_win_probability,
    1 - probability AS t_win_probability, CASE WHEN abs(probability - 0.5) < 0.01 THEN 'even'
    WHEN probability > 0.5 THEN 'CT' ELSE 'T' END AS favoured_side,
    abs(probability - 0.5) * 2 AS confidence FROM ev"""
)
def prediction_columns(spark, sf_dir):
    return b.events(spark, sf_dir).select(
        "match_id", "sequence", *scoring.prediction_columns(F.col("probability"))
    )


_CONFIDENCE_SQL = f"""{EVENTS_SQL}, st AS (SELECT match_id, sequence, probability,
    count(*) OVER w AS n, stddev_pop(probability) OVER w AS sd FROM ev
    WINDOW w AS (PARTITION BY match_id ORDER BY sequence ROWS 7 PRECEDING)),
  parts AS (SELECT match_id, sequence, least(1, abs(probability - 0.5) * 2) AS decisiveness,
    CASE WHEN probability < 0.9 THEN 1 - probability / 3 ELSE CAST(0.25 AS DOUBLE) END AS support,
    CASE WHEN n < 3 THEN 1 ELSE greatest(0, 1 - sd / 0.15) END AS stability FROM st),
  conf AS (SELECT *, pow(greatest(decisiveness, 1e-6) * greatest(support, 1e-6)
    * greatest(stability, 1e-6), CAST(1 AS DOUBLE) / 3) AS score FROM parts)"""


@query(
    f"""WITH {_CONFIDENCE_SQL} SELECT match_id, sequence, round(decisiveness, 5) AS decisiveness,
    round(support, 5) AS support, round(stability, 5) AS stability, round(score, 5) AS score,
    CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS band,
    CASE WHEN decisiveness <= support AND decisiveness <= stability THEN 'decisiveness'
      WHEN support <= stability THEN 'training support' ELSE 'stability' END AS limited_by FROM conf"""
)
def confidence_scores(spark, sf_dir):
    from roundcast.plans.confidence import score_confidence

    p = F.col("probability")
    rows = b.events(spark, sf_dir).select(
        "match_id",
        "sequence",
        "probability",
        F.when(p < 0.9, 1.0 - p / 3.0).otherwise(0.25).alias("support"),
    )
    out = score_confidence(rows, "probability")
    return out.select(
        "match_id",
        "sequence",
        *[
            F.round(c, 5).alias(c)
            for c in ("decisiveness", "support", "stability", "score")
        ],
        "band",
        "limited_by",
    )


# --- live state -----------------------------------------------------------------------------
@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, round_number, value FROM (SELECT *,
    row_number() OVER (PARTITION BY match_id ORDER BY sequence DESC) AS rn FROM ev
    WHERE event_type = 'tick') WHERE rn = 1"""
)
def latest_snapshot(spark, sf_dir):
    ticks = b.events(spark, sf_dir).filter("event_type = 'tick'")
    return lv.latest_per_match(ticks, columns=["sequence", "round_number", "value"])


_NOW = "2024-01-30 00:00:00"
_LATEST_SQL = f"""{EVENTS_SQL}, latest AS (SELECT match_id, max(timestamp) AS written_at FROM ev
  WHERE event_type = 'tick' GROUP BY match_id)"""


@query(
    f"""WITH {_LATEST_SQL} SELECT match_id FROM latest
    WHERE written_at + INTERVAL 86400 SECOND > TIMESTAMP '{_NOW}'"""
)
def live_ids(spark, sf_dir):
    ticks = b.events(spark, sf_dir).filter("event_type = 'tick'")
    latest = ticks.groupBy("match_id").agg(F.max("timestamp").alias("written_at"))
    return lv.live_matches(latest, F.lit(_NOW).cast("timestamp"), ttl_seconds=86_400.0)


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, event_type FROM ev
    WHERE timestamp + INTERVAL 3600 SECOND > TIMESTAMP '{_NOW}'"""
)
def ttl_filter(spark, sf_dir):
    kept = lv.unexpired(b.events(spark, sf_dir), "timestamp", F.lit(_NOW).cast("timestamp"))
    return kept.select("match_id", "sequence", "event_type")


_HISTORY_SQL = f"""{_ROUND_ONCE_SQL}, history AS (SELECT * EXCLUDE (hn) FROM (SELECT *,
  row_number() OVER (PARTITION BY match_id ORDER BY round_number DESC) AS hn FROM once)
  WHERE hn <= 64)"""


@query(
    f"WITH {_HISTORY_SQL} SELECT match_id, round_number, winner, reason, score_ct, score_t, sequence FROM history"
)
def round_history(spark, sf_dir):
    return lv.round_history(b.customer_rounds(spark, sf_dir))


_STREAK_SQL = f"""{_HISTORY_SQL}, lastw AS (SELECT match_id, arg_max(winner, round_number) AS streak_side,
    count(*) AS n, count(*) FILTER (winner = 'CT') AS ct_wins FROM history GROUP BY match_id),
  brk AS (SELECT h.match_id, max(round_number) FILTER (h.winner <> l.streak_side) AS broken
    FROM history h JOIN lastw l USING (match_id) GROUP BY h.match_id),
  summary AS (SELECT l.match_id, n AS rounds_played, ct_wins, n - ct_wins AS t_wins, streak_side,
    (SELECT count(*) FROM history h WHERE h.match_id = l.match_id
      AND h.round_number > coalesce(b.broken, -1)) AS streak_length
    FROM lastw l JOIN brk b USING (match_id))"""


@query(f"WITH {_STREAK_SQL} SELECT * FROM summary")
def current_streak(spark, sf_dir):
    return lv.history_summary(lv.round_history(b.customer_rounds(spark, sf_dir)))


@query(
    f"""WITH {_STREAK_SQL} SELECT c_custkey AS match_id, coalesce(rounds_played, 0) AS rounds_played,
    coalesce(ct_wins, 0) AS ct_wins, coalesce(t_wins, 0) AS t_wins,
    coalesce(streak_side, '') AS streak_side, coalesce(streak_length, 0) AS streak_length
    FROM customer LEFT JOIN summary ON match_id = c_custkey"""
)
def match_with_history(spark, sf_dir):
    matches = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match_id"))
    summary = lv.history_summary(lv.round_history(b.customer_rounds(spark, sf_dir)))
    joined = lv.with_history(matches, summary).fillna({"streak_side": ""})
    return joined.withColumn("streak_length", F.col("streak_length").cast("long"))


@query(
    f"""WITH {_CUSTOMER_ROUNDS_SQL}, bef AS (SELECT match_id, sequence, score_ct,
    lag(score_ct, 1, 0) OVER (PARTITION BY match_id ORDER BY sequence) AS score_before FROM cr)
    SELECT *, CASE WHEN score_ct > score_before THEN 'CT' ELSE 'T' END AS round_winner FROM bef"""
)
def running_scoreline(spark, sf_dir):
    rounds = b.customer_rounds(spark, sf_dir).select("match_id", "sequence", "score_ct")
    return lv.running_scoreline(rounds, order="sequence")


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, probability FROM (SELECT *, row_number() OVER
    (PARTITION BY match_id ORDER BY sequence) AS rn FROM ev WHERE event_type = 'tick') WHERE rn % 8 = 0"""
)
def systematic_sample(spark, sf_dir):
    ticks = b.events(spark, sf_dir).filter("event_type = 'tick'")
    return lv.systematic_sample(ticks.select("match_id", "sequence", "probability"), 8)


@query(
    f"""WITH {EVENTS_SQL}, ends AS (SELECT match_id, max(sequence) AS last_end FROM ev
      WHERE event_type = 'round_end' GROUP BY match_id)
    SELECT ev.match_id, sequence, probability FROM ev LEFT JOIN ends USING (match_id)
    WHERE event_type = 'tick' AND sequence > coalesce(last_end, -1)
    QUALIFY row_number() OVER (PARTITION BY ev.match_id ORDER BY sequence DESC) <= 600"""
)
def probability_timeline(spark, sf_dir):
    rows = b.events(spark, sf_dir).withColumn(
        "event_type",
        F.when(F.col("event_type") == "tick", "prediction").otherwise(F.col("event_type")),
    )
    return lv.probability_timeline(rows).select("match_id", "sequence", "probability")


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence, winner, reason,
    CAST(row_number() OVER (PARTITION BY match_id ORDER BY sequence DESC) AS INT) AS position
    FROM ev WHERE event_type = 'round_end' QUALIFY position <= 32"""
)
def round_log(spark, sf_dir):
    ends = b.events(spark, sf_dir).filter("event_type = 'round_end'")
    return lv.round_log(ends.select("match_id", "sequence", "winner", "reason"))


_THROTTLE_US = 86_400_000_000
_THROTTLE_SQL = f"""{EVENTS_SQL}, tk AS (SELECT match_id, sequence, CAST(epoch_us(timestamp) AS BIGINT) AS us,
    row_number() OVER (PARTITION BY match_id ORDER BY sequence) AS rn FROM ev WHERE event_type = 'tick'),
  walk AS (SELECT match_id, sequence, us, rn, us AS last_us, true AS kept FROM tk WHERE rn = 1
    UNION ALL SELECT t.match_id, t.sequence, t.us, t.rn,
      CASE WHEN t.us - w.last_us >= {_THROTTLE_US} THEN t.us ELSE w.last_us END,
      t.us - w.last_us >= {_THROTTLE_US} FROM walk w JOIN tk t
      ON t.match_id = w.match_id AND t.rn = w.rn + 1)"""
_WALK_SQL = _THROTTLE_SQL


def _throttled(spark, sf_dir):
    ticks = b.events(spark, sf_dir).filter("event_type = 'tick'")
    timed = ticks.select("match_id", "sequence", micros(F.col("timestamp")).alias("us"))
    return lv.throttle(timed, 86_400.0, segment_seconds=86_400.0 * 8)


@query(f"WITH RECURSIVE {_WALK_SQL} SELECT match_id, sequence, kept FROM walk")
def throttle_frames(spark, sf_dir):
    return _throttled(spark, sf_dir).select("match_id", "sequence", "kept")


@query(
    f"""WITH RECURSIVE {_WALK_SQL} SELECT count(*) AS ticks_seen, count(*) FILTER (NOT kept) AS throttled,
    round(count(*) FILTER (NOT kept) / count(*), 6) AS throttle_rate FROM walk"""
)
def throttle_rate(spark, sf_dir):
    return _rounded(lv.throttle_counters(_throttled(spark, sf_dir)), "throttle_rate")


def _frames(spark, sf_dir):
    rows = b.events(spark, sf_dir)
    body = F.struct("round_number", "value").alias("body")
    base = ["match_id", "sequence", "timestamp"]
    ticks = rows.filter("event_type = 'tick'")
    return lv.frame_stream(
        ticks.select(*base, F.struct(F.col("probability").alias("p")).alias("body")),
        ticks.select(*base, body),
        rows.filter("event_type = 'round_end'").select(
            *base, F.struct("winner", "reason").alias("body")
        ),
        interval_seconds=86_400.0,
    )


_FRAMES_SQL = f"""{_WALK_SQL}, frames AS (
  SELECT 'prediction' AS type, match_id, sequence, '' AS extra FROM ev WHERE event_type = 'tick'
  UNION ALL SELECT 'tick', match_id, sequence, '' FROM walk WHERE kept
  UNION ALL SELECT 'round_end', match_id, sequence,
    concat('{{"winner":"', winner, '","reason":"', reason, '"}}') FROM ev WHERE event_type = 'round_end')"""


@query(f"WITH RECURSIVE {_FRAMES_SQL} SELECT type, match_id, sequence, extra FROM frames")
def frame_stream(spark, sf_dir):
    return _frames(spark, sf_dir).select(
        "type",
        "match_id",
        "sequence",
        F.when(F.col("type") == "round_end", F.col("payload")).otherwise("").alias("extra"),
    )


@query(
    f"""WITH RECURSIVE {_FRAMES_SQL}, agg AS (SELECT match_id,
      max(sequence) FILTER (type = 'prediction') AS p, max(sequence) FILTER (type = 'round_end') AS e,
      count(*) FILTER (type = 'round_end') AS rounds_ended, max(sequence) FILTER (type = 'tick') AS t
      FROM frames GROUP BY match_id)
    SELECT match_id, rounds_ended, t IS NOT NULL AS has_snapshot,
      p IS NOT NULL AND coalesce(e, -1) < p AS has_prediction FROM agg"""
)
def frame_fold(spark, sf_dir):
    state = lv.dashboard_state(_frames(spark, sf_dir))
    return state.select(
        "match_id",
        "rounds_ended",
        F.col("snapshot").isNotNull().alias("has_snapshot"),
        F.col("prediction").isNotNull().alias("has_prediction"),
    )


@query(
    """WITH last AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000),
    s AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM last)
    SELECT CAST(n AS BIGINT) AS count, round(m, 6) AS mean_ms,
      v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50_ms,
      v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95_ms,
      v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS p99_ms FROM s"""
)
def latency_percentiles(spark, sf_dir):
    return _rounded(lv.latency_report(b.events(spark, sf_dir), "value"), "mean_ms")


# --- display ----------------------------------------------------------------------------------
_LADDER_SQL = "[" + ", ".join(str(v) for v in fv.LOSS_LADDER) + "]"


def _bonus_sql(c):
    return f"CASE WHEN {c} <= 0 THEN 0 ELSE {_LADDER_SQL}[least({c}, 5)] END"


@query(
    f"""WITH {TICKS_SQL} SELECT match_id, sequence,
    round(CASE WHEN money_ct + money_t > 0 THEN money_ct / (money_ct + money_t) * 100 ELSE 50 END, 6) AS money_share,
    CASE WHEN money_ct >= 20000 THEN 'full buy' ELSE 'limited' END AS badge_ct,
    CASE WHEN money_t >= 20000 THEN 'full buy' ELSE 'limited' END AS badge_t,
    CAST({_bonus_sql('losses_ct')} AS INT) AS next_bonus_ct,
    CAST({_bonus_sql('losses_t')} AS INT) AS next_bonus_t FROM ticks"""
)
def economy_view(spark, sf_dir):
    c = F.col
    return b.ticks(spark, sf_dir).select(
        "match_id",
        "sequence",
        F.round(display.comparison_share(c("money_ct"), c("money_t")), 6).alias("money_share"),
        display.buy_badge(c("money_ct")).alias("badge_ct"),
        display.buy_badge(c("money_t")).alias("badge_t"),
        display.loss_bonus(c("losses_ct")).alias("next_bonus_ct"),
        display.loss_bonus(c("losses_t")).alias("next_bonus_t"),
    )


@query(
    f"""WITH {TICKS_SQL}, cl AS (SELECT match_id, sequence, map_name, bomb_planted, bomb_seconds,
      CASE WHEN bomb_planted AND bomb_seconds IS NOT NULL THEN bomb_seconds ELSE seconds_remaining END AS clock FROM ticks)
    SELECT match_id, sequence, clock,
      concat(CAST(CAST(floor(floor(clock) / 60) AS INT) AS STRING), ':', lpad(CAST(CAST(floor(clock) AS INT) % 60 AS STRING), 2, '0')) AS label,
      bomb_planted AND coalesce(bomb_seconds <= 10, false) AS urgent,
      concat(upper(substr(map_name, 4, 1)), substr(map_name, 5)) AS map FROM cl"""
)
def clock_labels(spark, sf_dir):
    c = F.col
    clock = display.active_clock(c("seconds_remaining"), c("bomb_planted"), c("bomb_seconds"))
    return b.ticks(spark, sf_dir).select(
        "match_id",
        "sequence",
        clock.alias("clock"),
        display.clock_label(clock).alias("label"),
        display.urgent(c("bomb_planted"), c("bomb_seconds")).alias("urgent"),
        display.map_label(c("map_name")).alias("map"),
    )


_WEAPON_OF_PART = f"{_WEAPONS_SQL}[p_partkey % 16 + 1]"
_COST_CASE = " ".join(f"WHEN '{w}' THEN {cost}" for w, cost in fv.WEAPON_COST.items())
_LABEL_CASE = " ".join(f"WHEN '{w}' THEN '{label}'" for w, label in fv.WEAPON_LABEL.items())


@query(
    f"""WITH w AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE {_WEAPON_OF_PART} END AS weapon FROM part)
    SELECT p_partkey, coalesce(weapon, '') AS weapon, CAST(coalesce(CASE weapon {_COST_CASE} END, 0)
      + CASE WHEN p_size > 40 THEN 1000 WHEN p_size > 10 THEN 650 ELSE 0 END
      + CASE WHEN p_size % 3 = 0 THEN 400 ELSE 0 END AS INT) AS loadout_value,
      coalesce(CASE weapon {_LABEL_CASE} END, '—') AS label,
      CASE WHEN p_size * 2 > 60 THEN 'healthy' WHEN p_size * 2 > 25 THEN 'hurt' ELSE 'critical' END AS band,
      coalesce(weapon IN ({', '.join(f"'{w}'" for w in fv.SIDE_WEAPONS['CT'])}), false) AS ct_can_buy,
      coalesce(weapon IN ({', '.join(f"'{w}'" for w in fv.SIDE_WEAPONS['T'])}), false) AS t_can_buy FROM w"""
)
def loadout_value(spark, sf_dir):
    weapons = F.array(*[F.lit(w) for w in fv.WEAPON_COST])
    part = b.table(spark, sf_dir, "part")
    weapon = F.when(
        F.col("p_partkey") % 17 != 0, F.get(weapons, (F.col("p_partkey") % 16).cast("int"))
    )
    size = F.col("p_size")
    rows = part.select("p_partkey", "p_size", weapon.alias("weapon"))
    w = F.col("weapon")
    return rows.select(
        "p_partkey",
        F.coalesce(w, F.lit("")).alias("weapon"),
        display.loadout_value(w, size - 10, size > 40, size % 3 == 0).alias("loadout_value"),
        display.weapon_label(w).alias("label"),
        display.health_band(size * 2).alias("band"),
        F.coalesce(display.legal_weapon(F.lit("CT"), w), F.lit(False)).alias("ct_can_buy"),
        F.coalesce(display.legal_weapon(F.lit("T"), w), F.lit(False)).alias("t_can_buy"),
    )


_REASON_CASE = " ".join(f"WHEN '{r}' THEN '{label}'" for r, label in fv.REASON_LABEL.items())


@query(
    f"""WITH {ROUNDS_SQL} SELECT match_id, CASE reason {_REASON_CASE} END AS reason_text,
    CASE winner WHEN 'CT' THEN 'T' ELSE 'CT' END AS loser FROM rounds"""
)
def outcome_labels(spark, sf_dir):
    return b.rounds(spark, sf_dir).select(
        "match_id",
        display.reason_label(F.col("reason")).alias("reason_text"),
        display.opponent(F.col("winner")).alias("loser"),
    )


# --- reports --------------------------------------------------------------------------------
@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, count(*) AS events,
    count(*) FILTER (event_type = 'tick') AS tick_events,
    count(*) FILTER (event_type = 'kill') AS kill_events,
    count(*) FILTER (event_type = 'bomb_planted') AS bomb_planted_events,
    count(*) FILTER (event_type = 'round_end') AS round_end_events,
    count(*) FILTER (event_type = 'round_end' AND winner = 'CT') AS ct_rounds,
    CASE WHEN round_end_events > 0 THEN ct_rounds / round_end_events ELSE 0 END AS ct_win_rate,
    CASE WHEN round_end_events > 0 THEN bomb_planted_events / round_end_events ELSE 0 END AS plant_rate
    FROM ev GROUP BY match_id"""
)
def match_report(spark, sf_dir):
    from roundcast.plans import reports

    return reports.match_report(b.events(spark, sf_dir))


@query(f"WITH {ROUNDS_SQL} SELECT reason, count(*) AS rounds FROM rounds GROUP BY reason")
def outcome_frequency(spark, sf_dir):
    from roundcast.plans import reports

    return reports.outcome_frequency(b.rounds(spark, sf_dir))


@query(
    f"""WITH {ROUNDS_SQL} SELECT reason, count(*) FILTER (winner = 'CT') AS "CT",
    count(*) FILTER (winner = 'T') AS "T" FROM rounds GROUP BY reason"""
)
def outcomes_by_side(spark, sf_dir):
    from roundcast.plans import reports

    return reports.outcomes_by_side(b.rounds(spark, sf_dir))


@query(
    f"""WITH {EVENTS_SQL}, th AS (SELECT match_id, count(*) AS events,
    count(*) FILTER (event_type = 'tick') AS ticks, count(*) FILTER (event_type = 'round_end') AS rounds,
    CAST(max(epoch_us(timestamp)) - min(epoch_us(timestamp)) AS DOUBLE) / 1000000 AS seconds FROM ev GROUP BY match_id)
    SELECT *, CASE WHEN seconds > 0 THEN events / seconds ELSE 0 END AS events_per_second FROM th"""
)
def replay_throughput(spark, sf_dir):
    from roundcast.plans import reports

    timed = b.events(spark, sf_dir).withColumn("us", micros(F.col("timestamp")))
    return reports.throughput(timed)


_IMPORTANCE = {
    "alive_delta": 0.33,
    "alive_ratio": 0.21,
    "health_ratio": 0.17,
    "time_fraction": 0.08,
    "equipment_ratio": 0.06,
    "score_delta": 0.04,
}
_IMPORTANCE_SQL = "importance AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({v} AS DOUBLE))" for k, v in _IMPORTANCE.items()
) + ") AS t(feature, importance))"


@query(
    f"""WITH {LABELLED_SQL}, feats AS ({FEATURES_SQL}), {_IMPORTANCE_SQL},
    long AS ({' UNION ALL '.join(f"SELECT match_id, sequence, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feats" for f in fv.FEATURES)})
    SELECT match_id, sequence, feature, value, coalesce(importance, 0) AS importance
    FROM long LEFT JOIN importance USING (feature)"""
)
def explained_prediction(spark, sf_dir):
    from roundcast.plans import reports

    return reports.explained_predictions(
        _features(spark, sf_dir), _IMPORTANCE, ["match_id", "sequence"]
    )


@query(
    f"""WITH {LABELLED_SQL}, feats AS ({FEATURES_SQL}), long AS ({_LONG_SQL}),
    ranked AS (SELECT feature, round(stddev_samp(value), 6) AS importance FROM long GROUP BY feature)
    SELECT * FROM ranked ORDER BY importance DESC, feature LIMIT 5"""
)
def top_features(spark, sf_dir):
    from roundcast.plans import reports

    spread = sm.describe_features(_features(spark, sf_dir))
    return reports.top_features(
        spread.select("feature", F.round("std", 6).alias("importance"))
    )


@query(
    f"""WITH {TICKS_SQL} SELECT count(*) AS ticks_seen,
    count(*) FILTER (phase IN ('live', 'bomb_planted')) AS predictions_published,
    count(*) FILTER (phase NOT IN ('live', 'bomb_planted')) AS skipped,
    round(count(*) FILTER (phase IN ('live', 'bomb_planted')) / count(*), 6) AS publish_rate FROM ticks"""
)
def worker_counters(spark, sf_dir):
    counters = lv.worker_counters(b.ticks(spark, sf_dir), scoreable(F.col("phase")))
    return _rounded(counters, "publish_rate")


@query(
    f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS n, max(sequence) AS last_sequence FROM ev GROUP BY event_type"
)
def event_dispatch(spark, sf_dir):
    from roundcast.sources.tables import route

    branches = route(b.events(spark, sf_dir), ["tick", "kill", "round_start", "round_end"])
    counted = [
        rows.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last_sequence")
        )
        for rows in branches.values()
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


# --- wire format and data quality ---------------------------------------------------------------
_REASONS = fv.ROUND_END_REASONS


def _payloads(spark, sf_dir):
    return _payload_columns(b.table(spark, sf_dir, "events"))


def _payload_columns(events: DataFrame) -> DataFrame:
    """Raw JSON messages from the events table; many of them break a rule."""
    e = F.col("event_id")
    weapons = F.array(*[F.lit(w) for w in (*fv.WEAPON_COST, "railgun")])
    reasons = F.array(*[F.lit(r) for r in _REASONS])

    def part(text: str, *values) -> F.Column:
        return F.format_string(text, *values)

    number = (e % 70).cast("int")
    body = (
        F.when(
            F.col("event_type") == "signup",
            part(
                '"event_type":"round_start","round_number":%d,"score_ct":%d,"score_t":3',
                number,
                e % 66,
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            part(
                '"event_type":"kill","round_number":1,"killer_id":"p%d","victim_id":"p%d",'
                '"assister_id":"p%d","weapon":"%s","headshot":%s,"victim_team":"CT"',
                e % 5,
                e % 7,
                e % 11,
                F.get(weapons, (e % 17).cast("int")),
                (F.col("value") > 20).cast("string"),
            ),
        )
        .when(
            F.col("event_type") == "view",
            part(
                '"event_type":"bomb_planted","round_number":2,"planter_id":"p1","site":"%s"',
                F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (e % 3).cast("int")),
            ),
        )
        .when(
            F.col("event_type") == "click",
            part(
                '"event_type":"bomb_defused","round_number":3,"defuser_id":"p2","seconds_remaining":%s',
                F.col("value").cast("string"),
            ),
        )
        .otherwise(
            part(
                '"event_type":"round_end","round_number":4,"winner":"%s","reason":"%s",'
                '"score_ct":1,"score_t":0',
                F.when(e % 2 == 0, "CT").otherwise("T"),
                F.get(reasons, (e % 5).cast("int")),
            )
        )
    )
    extra = F.when(e % 41 == 0, ',"cheat":1').otherwise("")
    end = F.when(e % 50 == 7, "").otherwise("}")
    return events.select(
        "event_id",
        "user_id",
        F.concat(
            part('{"match_id":"u%d","sequence":%d,', F.col("user_id"), e), body, extra, end
        ).alias("value"),
    )


_ENDS_CT = ", ".join(f"'{r}'" for r in fv.REASONS_ONLY_CT_WINS)
_ENDS_T = ", ".join(f"'{r}'" for r in fv.REASONS_ONLY_T_WINS)
_REASON_SQL = "[" + ", ".join(f"'{r}'" for r in _REASONS) + "][event_id % 5 + 1]"
_VIOLATION_SQL = {
    "assister_distinct": "event_type = 'purchase' AND (event_id % 11 = event_id % 5 OR event_id % 11 = event_id % 7)",
    "defuse_seconds": "event_type = 'click' AND value > 40",
    "plant_site": "event_type = 'view' AND event_id % 3 = 2",
    "reason_matches_winner": (
        f"event_type = 'error' AND ((event_id % 2 = 0 AND {_REASON_SQL} IN ({_ENDS_T})) "
        f"OR (event_id % 2 = 1 AND {_REASON_SQL} IN ({_ENDS_CT})))"
    ),
    "required_fields": "event_id % 50 = 7",
    "round_number_range": "event_type = 'signup' AND (event_id % 70 = 0 OR event_id % 70 > 64)",
    "score_range": "event_type = 'signup' AND event_id % 66 > 64",
    "unknown_fields": "event_id % 41 = 0",
    "vocabulary": "event_type = 'purchase' AND event_id % 17 = 16",
}
_BROKEN_SQL = "CASE WHEN event_id % 50 = 7 THEN 'required_fields' ELSE concat_ws(',', " + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END"
    for name, test in _VIOLATION_SQL.items()
    if name != "required_fields"
) + ") END"
_CHECKED_SQL = f"checked AS (SELECT *, {_BROKEN_SQL} AS violations FROM events)"


def _checked(spark, sf_dir):
    from roundcast.sources.rules import checked

    return checked(_payloads(spark, sf_dir))


@query(f"WITH {_CHECKED_SQL} SELECT event_id, violations FROM checked")
def validate_events(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "event_id", F.array_join("violations", ",").alias("violations")
    )


@query(
    f"""WITH {_CHECKED_SQL}, r AS (SELECT unnest(string_split(violations, ',')) AS violated_rule, event_id FROM checked
    WHERE violations <> '') SELECT violated_rule, count(*) AS events, min(event_id) AS first_event FROM r GROUP BY violated_rule"""
)
def quarantine(spark, sf_dir):
    from roundcast.sources.rules import split_valid

    _, bad = split_valid(_checked(spark, sf_dir))
    return (
        bad.select("event_id", F.explode("violations").alias("violated_rule"))
        .groupBy("violated_rule")
        .agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))
    )


@query(
    f"""WITH {_CHECKED_SQL} SELECT count(*) FILTER (violations = '') AS events_consumed,
    count(*) FILTER (violations <> '') AS events_failed,
    max(event_id) FILTER (violations = '') AS last_sequence,
    round(count(*) FILTER (violations = '') / count(*), 6) AS success_rate FROM checked"""
)
def stream_counters(spark, sf_dir):
    rows = _checked(spark, sf_dir).select(
        F.size("violations").alias("n"),
        F.col("event.sequence").alias("sequence"),
        F.col("event_id").alias("arrival"),
    )
    return _rounded(lv.consumer_counters(rows, F.col("n") == 0), "success_rate")


@query(
    """SELECT concat('u', CAST(user_id AS STRING)) AS match_id, event_id AS sequence,
    CAST(epoch_us(ts) AS BIGINT) AS us, CAST(event_id % 64 + 1 AS INT) AS round_number,
    concat('v', CAST(event_id % 10 AS STRING)) AS victim_id, value > 20 AS headshot, true AS valid
    FROM events"""
)
def encode_decode(spark, sf_dir):
    from roundcast.sources.events import encode
    from roundcast.sources.rules import checked

    e = F.col("event_id")
    kills = b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("match_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        e.alias("sequence"),
        F.lit("kill").alias("event_type"),
        (e % 64 + 1).cast("int").alias("round_number"),
        F.concat(F.lit("v"), (e % 10).cast("string")).alias("victim_id"),
        F.lit("ak47").alias("weapon"),
        (F.col("value") > 20).alias("headshot"),
        F.lit("T").alias("victim_team"),
    )
    back = checked(encode(kills).select("value"))
    return back.select(
        "event.match_id",
        "event.sequence",
        F.unix_micros("event.timestamp").alias("us"),
        "event.round_number",
        "event.victim_id",
        "event.headshot",
        (F.size("violations") == 0).alias("valid"),
    )


@query(
    "SELECT "
    + ", ".join(f"{TICK[c]} AS {c}" for c in ["match_id", "sequence", "phase", "money_ct"])
    + f", CAST({_ALIVE_CT_SQL} AS INT) AS alive_ct, CAST({_HEALTH_T_SQL} AS INT) AS health_t"
    + ", true AS valid FROM lineitem"
)
def snapshot_round_trip(spark, sf_dir):
    from roundcast.sources.events import encode
    from roundcast.sources.rules import checked

    ticks = b.snapshots(spark, sf_dir).withColumns(
        {
            "event_type": F.lit("tick"),
            "timestamp": F.col("timestamp").cast("timestamp"),
            "state": F.col("state")
            .withField("timestamp", F.col("state.timestamp").cast("timestamp"))
            .withField("round_state.bomb_position", F.lit(None).cast(
                "struct<x:double,y:double,z:double>")),
        }
    )
    back = checked(encode(ticks).select("value"))
    flat = back.select(
        "event.match_id",
        "event.sequence",
        *snapshot.tick_columns(F.col("event.state")),
        (F.size("violations") == 0).alias("valid"),
    )
    return flat.select(
        "match_id", "sequence", "phase", "money_ct", "alive_ct", "health_t", "valid"
    )


#: What is broken in a snapshot, by its match and sequence modulo 16, and the rules that say so.
_BREAKS = {
    1: "match_id_length,state_match_id",
    2: "sequence_range",
    3: "state_match_id",
    4: "position_bounds",
    5: "player_ranges",
    6: "dead_hold_nothing",
    7: "helmet_needs_armour",
    8: "kit_only_ct",
    9: "bomb_timer",
    10: "planted_phase",
    11: "economy_side",
    12: "player_ids",
    13: "vocabulary",
    14: "name_length",
    15: "field_type",
}


@query(
    f"SELECT {TICK['match_id']} AS of_match, {TICK['sequence']} AS of_sequence, "
    "CASE (l_orderkey + l_linenumber) % 16 "
    + " ".join(f"WHEN {k} THEN '{names}'" for k, names in _BREAKS.items())
    + " ELSE '' END AS violations FROM lineitem"
)
def validate_snapshots(spark, sf_dir):
    """Each rule of a snapshot broken alone in one snapshot of sixteen."""
    from roundcast.sources.events import encode
    from roundcast.sources.rules import checked

    number = F.expr("CAST(substr(match_id, 2) AS BIGINT)")
    kind = F.pmod(number + F.col("sequence"), F.lit(16))

    def broken(n: int, value: F.Column, otherwise: F.Column) -> F.Column:
        return F.when(kind == n, value).otherwise(otherwise)

    state = F.col("state").withField("timestamp", F.col("state.timestamp").cast("timestamp"))
    state = state.withField(
        "round_state.bomb_position", F.lit(None).cast("struct<x:double,y:double,z:double>")
    )
    players = F.col("state.players")
    first = F.get(players, 0).withField("health", F.lit(100)).withField("armour", F.lit(0))
    first = first.withField("has_helmet", F.lit(False)).withField("has_defuse_kit", F.lit(False))
    changes = {
        4: first.withField("position.x", F.lit(1e9)),
        5: first.withField("health", F.lit(101)),
        6: first.withField("health", F.lit(0)).withField("armour", F.lit(50)),
        7: first.withField("has_helmet", F.lit(True)),
        8: first.withField("team", F.lit("T")).withField("has_defuse_kit", F.lit(True)),
        13: first.withField("primary_weapon", F.lit("railgun")),
        14: first.withField("name", F.lit("")),
    }
    head = F.get(players, 0)
    for n, value in changes.items():
        head = broken(n, value, head)
    rest = F.slice(players, 2, 64)
    listed = broken(12, F.array(first, first), F.concat(F.array(head), rest))
    on, planted = F.col("state.round_state"), F.lit(True)
    state = (
        state.withField("players", listed)
        .withField("match_id", broken(3, F.lit("another"), F.col("state.match_id")))
        .withField("economy_ct.team", broken(11, F.lit("T"), F.col("state.economy_ct.team")))
        .withField("round_state.phase", broken(9, F.lit("live"), broken(10, F.lit("bomb_planted"), on["phase"])))
        .withField("round_state.bomb_planted", broken(9, planted, broken(10, F.lit(False), on["bomb_planted"])))
        .withField(
            "round_state.bomb_seconds_remaining",
            F.when(~kind.isin(9, 10), on["bomb_seconds_remaining"]),
        )
    )
    ticks = b.snapshots(spark, sf_dir).select(
        F.col("match_id").alias("of_match"),
        F.col("sequence").alias("of_sequence"),
        broken(1, F.lit(""), F.col("match_id")).alias("match_id"),
        broken(2, F.lit(-1).cast("long"), F.col("sequence").cast("long")).alias("sequence"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.lit("tick").alias("event_type"),
        state.alias("state"),
        kind.alias("kind"),
    )
    sent = encode(ticks).withColumn(
        "value", F.when(F.col("kind") == 15, F.concat("value", F.lit(" {}"))).otherwise(F.col("value"))
    )
    return checked(sent.select("of_match", "of_sequence", "value")).select(
        "of_match", "of_sequence", F.array_join("violations", ",").alias("violations")
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, sequence,
    CASE WHEN CASE winner WHEN 'CT' THEN score_ct > score_t ELSE score_t > score_ct END THEN '' ELSE 'winner_has_higher_score' END
    AS violations FROM ev WHERE event_type = 'round_end'"""
)
def match_end_scores(spark, sf_dir):
    """Match ends, made from round ends, of which some have a winner with no higher score."""
    from roundcast.sources.events import encode
    from roundcast.sources.rules import checked

    ends = b.events(spark, sf_dir).filter("event_type = 'round_end'").select(
        F.col("match_id").alias("of_match"),
        F.col("match_id").cast("string").alias("match_id"),
        F.col("sequence").cast("long").alias("sequence"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.lit("match_end").alias("event_type"),
        "winner",
        "score_ct",
        "score_t",
    )
    sent = encode(ends)
    return checked(sent.select("of_match", F.col("sequence").alias("of_sequence"), "value")).select(
        F.col("of_match").alias("match_id"), F.col("of_sequence").alias("sequence"), F.array_join("violations", ",").alias("violations")
    )


@query(f"SELECT {TICK['match_id']} AS match_id, {TICK['sequence']} AS sequence FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0")
def stale_snapshots(spark, sf_dir):
    """Stored snapshots without those that no longer pass the rules: a third has a player of more than full health."""
    from roundcast.sources.rules import drop_stale

    number = F.expr("CAST(substr(match_id, 2) AS BIGINT)")
    state = F.col("state").withField("timestamp", F.col("state.timestamp").cast("timestamp"))
    state = state.withField("round_state.bomb_position", F.lit(None).cast("struct<x:double,y:double,z:double>"))
    players = F.col("state.players")
    spoiled = F.concat(F.array(F.get(players, 0).withField("health", F.lit(101))), F.slice(players, 2, 64))
    stale = F.pmod(number + F.col("sequence"), F.lit(3)) == 0
    state = state.withField("players", F.when(stale, spoiled).otherwise(players))
    rows = b.snapshots(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("state", state)
    return drop_stale(rows).select("match_id", F.col("sequence").cast("long").alias("sequence"))


@query(
    f"WITH t AS ({projection(TICK, 'lineitem')}) SELECT phase, count(*) AS ticks, min(match_id) AS first_match "
    "FROM t WHERE phase <> 'over' GROUP BY phase"
)
def live_phases(spark, sf_dir):
    rows = b.ticks(spark, sf_dir).filter(live(F.col("phase")))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("ticks"), F.min("match_id").alias("first_match"))


# --- streaming twins -----------------------------------------------------------------------------
def _cores(spark) -> int:
    return spark.sparkContext.defaultParallelism


def _event_stream(spark, sf_dir):
    from roundcast.session import use_utc
    from roundcast.streaming.jobs import configure_state, read_table_stream

    stream = read_table_stream(configure_state(use_utc(spark)), sf_dir, "events.parquet")
    return b.bind(stream, EVENT)


@query(f"WITH {_MOMENTUM_SQL} SELECT * FROM momentum")
def stream_momentum(spark, sf_dir):
    from roundcast.streaming.jobs import run_to_end, scratch_pair
    from roundcast.streaming.processor import stream_momentum as run

    out = run(_event_stream(spark, sf_dir), span_seconds=MOMENTUM_SPAN)
    path, log = scratch_pair(spark, "momentum")
    return spark.read.parquet(run_to_end(out, path, log, state_partitions=_cores(spark)))


@query(ORACLE["latest_snapshot"])
def stream_latest(spark, sf_dir):
    from roundcast.streaming import jobs

    ticks = _event_stream(spark, sf_dir).filter("event_type = 'tick'")
    path, log = jobs.scratch_pair(spark, "latest")
    write = jobs.write_latest(path, ["match_id"], ["sequence"], ["sequence", "round_number", "value"])
    jobs.run_batches(ticks, write, log)
    return jobs.read_updates(spark, path, ["match_id"])


@query(
    f"""WITH {EVENTS_SQL}, once AS (SELECT match_id, round_number, winner, reason, score_ct, score_t
      FROM ev WHERE event_type = 'round_end'
      QUALIFY row_number() OVER (PARTITION BY match_id, round_number ORDER BY sequence DESC) = 1)
    SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY round_number DESC) <= 64"""
)
def stream_history(spark, sf_dir):
    from roundcast.operators.scan import last_rows
    from roundcast.streaming import jobs

    ends = _event_stream(spark, sf_dir).filter("event_type = 'round_end'")
    keys = ["match_id", "round_number"]
    path, log = jobs.scratch_pair(spark, "history")
    write = jobs.write_latest(path, keys, ["sequence"], ["winner", "reason", "score_ct", "score_t"])
    jobs.run_batches(ends, write, log)
    current = jobs.read_updates(spark, path, keys)
    return last_rows(current, ["match_id"], [F.col("round_number")], fv.RETAINED_ROUNDS)


_SCORED_SQL = f"""WITH {_MOMENTUM_SQL}, sc AS (SELECT match_id, sequence,
      CASE WHEN window_seconds > 0 THEN (kills_ct + kills_t) / window_seconds ELSE 0 END AS pace,
      greatest(-1, least(1, (kills_ct - kills_t) / 5)) AS delta, headshots FROM momentum)
    SELECT match_id, sequence, round(0.5 + delta * 0.25 + pace, 6) AS ct_win_probability,
      CASE WHEN abs(delta * 0.25 + pace) < 0.01 THEN 'even' WHEN delta * 0.25 + pace > 0 THEN 'CT' ELSE 'T' END
      AS favoured_side FROM sc"""


def _scored_stream(spark, sf_dir):
    from roundcast.streaming import jobs
    from roundcast.streaming.processor import stream_momentum as run

    windows = run(
        _event_stream(spark, sf_dir), span_seconds=MOMENTUM_SPAN, keep=("round_number",)
    )
    level = {
        c: F.lit(0)
        for c in TICK
        if c not in ("match_id", "sequence", "timestamp", "round_number", "phase", "map_name")
    }
    ticks = windows.withColumns(
        {
            **level,
            "phase": F.lit("live"),
            "bomb_planted": F.lit(False),
            "kills_ct_window": F.col("kills_ct"),
            "kills_t_window": F.col("kills_t"),
            "window_seconds": F.col("window_seconds"),
        }
    )

    def score(features):
        p = 0.5 + F.col("kill_delta_window") * 0.25 + F.col("engagement_pace")
        return features.withColumn("ct_win_probability", p)

    return jobs.score_ticks(ticks, score)


@query(_SCORED_SQL)
def stream_scoring(spark, sf_dir):
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "scoring")
    jobs.run_to_end(_scored_stream(spark, sf_dir), path, log, state_partitions=_cores(spark))
    return spark.read.parquet(path).select(
        "match_id", "sequence", "ct_win_probability", "favoured_side"
    )


@query(f"SELECT * FROM ({_SCORED_SQL}) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY sequence DESC) = 1")
def stream_predictions(spark, sf_dir):
    """The latest prediction of every match: scored in the stream, kept by its last arrival."""
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "predictions")
    write = jobs.write_latest(
        path, ["match_id"], ["sequence"], ["sequence", "ct_win_probability", "favoured_side"]
    )
    jobs.run_batches(_scored_stream(spark, sf_dir), write, log, "append", state_partitions=_cores(spark))
    return jobs.read_updates(spark, path, ["match_id"])


_PARTS = 4
# event_id in equal ranges, each arriving as a whole; the first one is sent once more at the end
_ARRIVALS_SQL = f"""{EVENTS_SQL}, bounds AS (SELECT min(sequence) AS lo, max(sequence) AS hi FROM ev),
  parted AS (SELECT ev.*, least({_PARTS - 1}, ((sequence - lo) * {_PARTS}) // (hi - lo + 1)) AS part FROM ev, bounds),
  arrived AS (SELECT * FROM parted UNION ALL SELECT * REPLACE ({_PARTS} AS part) FROM parted WHERE part = 0),
  tk AS (SELECT match_id, sequence, part, probability, CAST(epoch_us(timestamp) AS BIGINT) AS us,
    row_number() OVER (PARTITION BY match_id ORDER BY part, sequence) AS rn FROM arrived WHERE event_type = 'tick'),
  walk AS (SELECT match_id, sequence, part, rn, us AS last_us, true AS kept FROM tk WHERE rn = 1
    UNION ALL SELECT t.match_id, t.sequence, t.part, t.rn,
      CASE WHEN t.us - w.last_us >= {_THROTTLE_US} THEN t.us ELSE w.last_us END,
      t.us - w.last_us >= {_THROTTLE_US} FROM walk w JOIN tk t
      ON t.match_id = w.match_id AND t.rn = w.rn + 1)"""


def _arrivals(spark, sf_dir, run, files=None) -> None:
    """Events land part by part, and ``run`` drains the folder after each: micro-batches with a restart between them."""
    from roundcast.session import scratch_path, use_utc
    from roundcast.streaming.jobs import configure_state, read_table_stream

    use_utc(spark)
    payload = F.when(F.col("event_type") == "round_end", F.concat_ws(":", "winner", "reason")).otherwise(F.col("sequence").cast("string"))
    rows = b.events(spark, sf_dir).withColumn("payload", payload)
    lo, hi = rows.agg(F.min("sequence"), F.max("sequence")).first()
    if lo is None:
        lo = hi = 0
    part = F.least(F.lit(_PARTS - 1), F.floor((F.col("sequence") - lo) * _PARTS / (hi - lo + 1)))
    folder = scratch_path(spark, "landing")
    for k in (*range(_PARTS), 0):
        rows.filter(part == k).write.mode("append").parquet(folder)
        options = {"maxFilesPerTrigger": str(files)} if files else None
        run(read_table_stream(configure_state(spark), folder, "*.parquet", options))


@query(
    f"""WITH RECURSIVE {_ARRIVALS_SQL} SELECT 'prediction' AS type, match_id, sequence, '' AS extra FROM tk
    UNION ALL SELECT 'tick', match_id, sequence, CAST(sequence AS VARCHAR) FROM walk WHERE kept
    UNION ALL SELECT 'round_end', match_id, sequence, concat(winner, ':', reason) FROM arrived WHERE event_type = 'round_end'"""
)
def stream_frames(spark, sf_dir):
    """Live frames: snapshots throttled by state that lives on between micro-batches, replays among the events."""
    from roundcast.streaming import jobs
    from roundcast.streaming.frames import stream_frames as run

    path, log = jobs.scratch_pair(spark, "frames")

    def drain(events):
        out = run(events, prediction="probability", interval_seconds=86_400.0)
        jobs.run_to_end(out, path, log, state_partitions=_cores(spark))

    _arrivals(spark, sf_dir, drain)
    return spark.read.parquet(path).select("type", "match_id", "sequence", F.coalesce("payload", F.lit("")).alias("extra"))


@query(
    f"""WITH RECURSIVE {_ARRIVALS_SQL}, ends AS (SELECT match_id, part, sequence, concat(winner, ':', reason) AS payload,
      row_number() OVER (PARTITION BY match_id ORDER BY part DESC, sequence DESC) AS k FROM arrived WHERE event_type = 'round_end'),
    since AS (SELECT tk.*, row_number() OVER (PARTITION BY tk.match_id ORDER BY rn DESC) AS k FROM tk
      LEFT JOIN (SELECT * FROM ends WHERE k = 1) e ON e.match_id = tk.match_id
      WHERE e.match_id IS NULL OR (tk.part, tk.sequence) > (e.part, e.sequence)),
    seen AS (SELECT DISTINCT match_id FROM arrived WHERE event_type IN ('tick', 'round_end'))
    SELECT match_id, coalesce(rounds, 0) AS rounds_ended, snapshot, round(prediction, 6) AS prediction,
      coalesce(timeline, '') AS timeline, coalesce(log, '') AS log
    FROM seen LEFT JOIN (SELECT match_id, count(*) AS rounds, string_agg(payload, ',' ORDER BY k) FILTER (k <= 32) AS log FROM ends GROUP BY 1) USING (match_id)
    LEFT JOIN (SELECT match_id, CAST(arg_max(sequence, rn) AS VARCHAR) AS snapshot FROM walk WHERE kept GROUP BY 1) USING (match_id)
    LEFT JOIN (SELECT match_id, arg_max(probability, rn) AS prediction,
      string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY rn) FILTER (k <= 600) AS timeline FROM since GROUP BY 1) USING (match_id)"""
)
def stream_view(spark, sf_dir):
    """What a viewer sees of every match after all arrivals: snapshot, prediction, timeline and log, folded in the stream."""
    from roundcast.streaming import jobs
    from roundcast.streaming.frames import stream_view as run

    path, log = jobs.scratch_pair(spark, "view")

    def drain(events):
        out = run(events, prediction="probability", interval_seconds=86_400.0)
        jobs.run_batches(out, jobs.write_updates(path, "0"), log, "update", state_partitions=_cores(spark))

    _arrivals(spark, sf_dir, drain)
    view = jobs.read_updates(spark, path, ["match_id"])
    return view.select(
        "match_id",
        "rounds_ended",
        "snapshot",
        F.round("prediction", 6).alias("prediction"),
        F.array_join(F.col("timeline").cast("array<string>"), ",").alias("timeline"),
        F.array_join("log", ",").alias("log"),
    )


@query(
    f"""WITH {_ARRIVALS_SQL.split(",\n  tk AS")[0]}, n AS (SELECT part, count(*) FILTER (event_type = 'tick') AS ticks,
      count(*) FILTER (event_type = 'round_end') AS rounds FROM arrived GROUP BY part)
    SELECT 'rounds' AS route, CAST(sum(rounds) AS BIGINT) AS written, count(*) AS flushes, round(sum(rounds) / count(*), 6) AS mean_rows FROM n
    UNION ALL SELECT 'ticks', CAST(sum(ticks) AS BIGINT), count(*), round(sum(ticks) / count(*), 6) FROM n"""
)
def sink_counters(spark, sf_dir):
    """Rows written by each route of a routed stream and rows per flush, as its batches observed them."""
    from roundcast.session import scratch_path
    from roundcast.streaming import jobs

    _, log = jobs.scratch_pair(spark, "sinks")
    counted = scratch_path(spark, "sink-counts")
    routes = {
        "ticks": (lambda batch: batch.filter("event_type = 'tick'"), scratch_path(spark, "ticks")),
        "rounds": (lambda batch: batch.filter("event_type = 'round_end'"), scratch_path(spark, "rounds")),
    }
    write = jobs.route_batch(routes, "0", counts=counted)
    # a landing is one micro-batch, however many files it has
    _arrivals(spark, sf_dir, lambda events: jobs.run_batches(events, write, log, "append"), files=1_000_000)
    return _rounded(jobs.sink_counters(spark, counted), "mean_rows")


@query(
    f"""WITH {_ARRIVALS_SQL.split(",\n  tk AS")[0]}, wanted AS (SELECT (count(*) * 3) // 5 AS n FROM ev),
    ranked AS (SELECT *, row_number() OVER (ORDER BY part, sequence) AS rn FROM arrived)
    SELECT event_type, count(*) AS taken, min(sequence) AS first_sequence, max(sequence) AS last_sequence,
      CAST(sum(sequence) AS BIGINT) AS sequences FROM ranked, wanted WHERE rn <= n GROUP BY event_type"""
)
def stream_first_events(spark, sf_dir):
    """The first three fifths of all events as they arrive, an end that falls inside a micro-batch."""
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "first")
    wanted = b.events(spark, sf_dir).count() * 3 // 5
    _arrivals(spark, sf_dir, lambda events: jobs.take_first(events, wanted, path, log, ["sequence"]), files=1_000_000)
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("taken"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.sum("sequence").alias("sequences"),
    )


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT count(*) FILTER (event_type = 'tick') AS ticks,
      count(*) FILTER (event_type = 'round_end') AS rounds FROM ev)
    SELECT 'ticks' AS sink, 'complete' AS state, 0 AS restarts, ticks AS stored_rows FROM n
    UNION ALL SELECT 'rounds', 'complete', 1, rounds FROM n UNION ALL SELECT 'broken', 'failed', 2, 0 FROM n"""
)
def sink_isolation(spark, sf_dir):
    """Three sinks of one stream: a sound one, one that fails once, one that always fails."""
    from roundcast.session import scratch_path
    from roundcast.streaming import jobs

    paths = {name: scratch_path(spark, name) for name in ("ticks", "rounds", "broken")}
    kinds = {"ticks": "tick", "rounds": "round_end", "broken": "kill"}
    failures = {"rounds": 1, "broken": 1_000_000}

    def writer(name):
        store = jobs.write_updates(paths[name], "0")

        def write(batch, batch_id):
            if failures.get(name, 0):
                failures[name] -= 1
                raise OSError(f"{name} can't be written")
            store(batch.filter(F.col("event_type") == kinds[name]), batch_id)

        return write

    sinks = {name: (writer(name), scratch_path(spark, f"{name}-log")) for name in paths}
    found = jobs.run_isolated(_event_stream(spark, sf_dir), sinks)
    report = spark.createDataFrame([(k, state, used) for k, (state, used, _) in found.items()], "sink string, state string, restarts int")
    complete = [k for k, (state, _, _) in found.items() if state == "complete"]
    stored = [spark.read.parquet(paths[k]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("sink"), "n") for k in complete]
    counts = reduce(DataFrame.unionByName, stored)
    return report.join(counts, "sink", "left").select(
        "sink", "state", "restarts", F.coalesce("n", F.lit(0)).alias("stored_rows")
    )


@query(
    f"""WITH {EVENTS_SQL}, lasts AS (SELECT match_id, max(sequence) FILTER (event_type = 'round_end') AS ended, max(sequence) AS last
      FROM ev GROUP BY match_id),
    open AS (SELECT match_id, ended FROM lasts WHERE ended IS NULL OR last > ended),
    held AS (SELECT ev.match_id, count(*) FILTER (event_type = 'round_start') AS epoch
      FROM ev JOIN open ON ev.match_id = open.match_id AND (ended IS NULL OR sequence > ended)
      WHERE event_type IN ('tick', 'kill', 'round_start') GROUP BY 1)
    SELECT match_id, epoch FROM held"""
)
def open_states(spark, sf_dir):
    """What a finished momentum stream still holds: the epoch of each match without an end, where a round end ends one."""
    from roundcast.streaming import jobs
    from roundcast.streaming.processor import stream_momentum as run

    kind = F.when(F.col("event_type") == "round_end", "match_end").otherwise(F.col("event_type"))
    ends = _event_stream(spark, sf_dir).withColumn("event_type", kind)
    path, log = jobs.scratch_pair(spark, "open")
    jobs.run_to_end(run(ends, span_seconds=MOMENTUM_SPAN), path, log, state_partitions=_cores(spark))
    return jobs.read_state(spark, log, "marks").select("match_id", "epoch")


@query(ORACLE["quarantine"])
def stream_quarantine(spark, sf_dir):
    from roundcast.session import use_utc
    from roundcast.streaming import jobs

    stream = jobs.read_table_stream(use_utc(spark), sf_dir, "events.parquet")
    _, bad = jobs.ingest(_payload_columns(stream))
    rows = bad.select("event_id", F.explode("violations").alias("violated_rule"))
    path = jobs.run_to_end(rows, *jobs.scratch_pair(spark, "quarantine"))
    return (
        spark.read.parquet(path)
        .groupBy("violated_rule")
        .agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT 'ticks' AS table_name, count(*) AS stored_rows FROM ev WHERE event_type = 'tick'
    UNION ALL SELECT 'rounds', count(DISTINCT (match_id, round_number)) FROM ev WHERE event_type = 'round_end'
    UNION ALL SELECT 'matches', count(DISTINCT match_id) FROM ev WHERE event_type = 'kill'"""
)
def stream_history_tables(spark, sf_dir):
    """One stream fanned out to three tables; kills stand in for match ends."""
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "tables")

    def branch(kind):
        return lambda rows: rows.filter(F.col("event_type") == kind)

    routes = {
        "ticks": (branch("tick"), f"{path}/ticks"),
        "rounds": (branch("round_end"), f"{path}/rounds"),
        "matches": (branch("kill"), f"{path}/matches"),
    }
    jobs.run_batches(_event_stream(spark, sf_dir), jobs.route_batch(routes), log, "append")

    def stored(name, keys):
        rows = spark.read.parquet(f"{path}/{name}")
        kept = lb.upsert(rows, keys, ["batch", "sequence"], ["score_ct"]) if keys else rows
        return kept.agg(F.count(F.lit(1)).alias("stored_rows")).select(
            F.lit(name).alias("table_name"), "stored_rows"
        )

    return (
        stored("ticks", None)
        .unionByName(stored("rounds", ["match_id", "round_number"]))
        .unionByName(stored("matches", ["match_id"]))
    )


@query(
    f"""WITH {TICKS_SQL} SELECT match_id, sequence, phase, alive_ct, 0 AS kills_ct_window,
    CAST(0 AS DOUBLE) AS window_seconds, 'kills_ct_window,kills_t_window,window_seconds' AS added FROM ticks"""
)
def schema_reconcile(spark, sf_dir):
    from roundcast.sources.tables import TICK_SCHEMA, reconcile

    old = b.ticks(spark, sf_dir).drop("kills_ct_window", "kills_t_window", "window_seconds")
    out, added = reconcile(old, TICK_SCHEMA)
    return out.select(
        "match_id",
        "sequence",
        "phase",
        "alive_ct",
        "kills_ct_window",
        "window_seconds",
        F.lit(",".join(added)).alias("added"),
    )


@query(
    f"""WITH {LABELLED_SQL} SELECT round_reason, count(*) AS stored_rows, CAST(sum(ct_won) AS BIGINT) AS won
    FROM labelled GROUP BY round_reason"""
)
def parquet_export(spark, sf_dir):
    from roundcast.session import scratch_path

    path = scratch_path(spark, "export")
    _labelled(spark, sf_dir).write.mode("overwrite").parquet(path)
    return (
        spark.read.parquet(path)
        .groupBy("round_reason")
        .agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("ct_won").cast("long").alias("won"))
    )


@query(ORACLE["parquet_export"])
def history_export(spark, sf_dir):
    """Training rows out of stored tables: written twice under one batch, joined by the label view, exported, read again."""
    from roundcast.session import scratch_path
    from roundcast.sources.tables import History

    history = History(spark, scratch_path(spark, "history"))
    rounds = b.rounds(spark, sf_dir).withColumn("sequence", F.lit(0).cast("long"))
    matches = rounds.select("match_id", "winner", "sequence")
    for _ in range(2):
        history.write(b.ticks(spark, sf_dir), rounds, matches, 0)
    path = history.export(scratch_path(spark, "exported"))
    return (
        spark.read.parquet(path)
        .groupBy("round_reason")
        .agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("ct_won").cast("long").alias("won"))
    )


# --- models (facts have SQL twins, fits have none) --------------------------------------------------------------------------
def _leaning(spark, sf_dir):
    """Labelled ticks whose label follows the manpower, so there is something to learn."""
    rows = lb.dedupe(b.ticks(spark, sf_dir)).filter(F.col("phase") != "freezetime")
    noise = F.pmod(F.xxhash64("match_id", "sequence"), F.lit(100)) / 100.0
    lean = F.expr(PROBABILITY)
    return rows.withColumn("ct_won", (noise < lean).cast("int"))


# pairs of scores from..to, whose mean labels give the fit by its max-min formula
_ISOTONIC_SQL = f"""{SCORED_SQL}, raw AS (
    SELECT floor(ct_win_probability * 500) / 500 AS score, ct_won FROM scored),
  points AS (SELECT score, CAST(sum(ct_won) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS weight FROM raw GROUP BY 1),
  summed AS (SELECT score, row_number() OVER w AS i, sum(total) OVER w AS t, sum(weight) OVER w AS n FROM points WINDOW w AS (ORDER BY score)),
  means AS (SELECT a.i AS i, b.i AS j, (b.t - coalesce(z.t, 0)) / (b.n - coalesce(z.n, 0)) AS mean
    FROM summed a JOIN summed b ON a.i <= b.i LEFT JOIN summed z ON z.i = a.i - 1),
  least_mean AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS mean FROM means),
  fit AS (SELECT score, (SELECT max(mean) FROM least_mean m WHERE m.j = s.i) AS y FROM summed s),
  ends AS (SELECT min(score) AS lo, max(score) AS hi FROM fit),
  grid AS (SELECT CAST(g AS INT) AS i, CASE WHEN g = {fv.CALIBRATOR_GRID - 1} THEN hi
    ELSE lo + g * ((hi - lo) / {fv.CALIBRATOR_GRID - 1}) END AS x FROM ends, range({fv.CALIBRATOR_GRID}) r(g)),
  near AS (SELECT i, x, max(score) FILTER (score <= x) AS a, min(score) FILTER (score > x) AS b FROM grid, fit GROUP BY i, x)"""


@query(
    f"""WITH {_ISOTONIC_SQL} SELECT (SELECT count(*) FROM raw) AS rows_fitted, i, round(x, 9) AS x,
    round(CASE WHEN b IS NULL THEN f.y ELSE f.y + (g.y - f.y) * ((x - a) / (b - a)) END, 9) AS y
    FROM near JOIN fit f ON f.score = a LEFT JOIN fit g ON g.score = b"""
)
def isotonic_fit(spark, sf_dir):
    """Breakpoints of the isotonic fit on all labelled ticks."""
    from roundcast.operators.calibrator import fit_calibrator, literal_points
    from roundcast.session import written

    score = F.floor(F.col("ct_win_probability") * 500) / 500
    # the fit and the count both read the rows, and a replay is found only by shuffling all ticks
    rows = written(_scored(spark, sf_dir).select("ct_won", score.alias("raw_probability")), "isotonic")
    xs, ys = fit_calibrator(rows)
    one = rows.agg(F.count(F.lit(1)).alias("rows_fitted"))
    return one.select("rows_fitted", F.posexplode(literal_points(xs, ys)).alias("i", "point")).select(
        "rows_fitted", "i", F.round("point.x", 9).alias("x"), F.round("point.y", 9).alias("y")
    )


_HELD_SQL = f"""{DEDUPED_SQL}, usable AS (SELECT * FROM deduped WHERE phase <> 'freezetime'),
  ids AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT match_id FROM usable)),
  sides AS (SELECT usable.*, i > n - greatest(1, round_even(n * 0.2, 0)) AS held FROM usable JOIN ids USING (match_id))"""


@query(
    f"""WITH {_HELD_SQL}, own AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT match_id FROM sides WHERE held))
    SELECT CASE WHEN i <= n // 2 THEN 'fit' ELSE 'report' END AS side, count(*) AS side_rows, count(DISTINCT match_id) AS matches,
      min(match_id) AS first_match, max(match_id) AS last_match, 'sides share no match' AS fact
    FROM sides JOIN own USING (match_id) GROUP BY 1"""
)
def calibrator_split(spark, sf_dir):
    """Held-out matches, halved into those that fit a calibrator and those that report on it."""
    _, held = lb.split_by_match(_leaning(spark, sf_dir))
    sides = [df.withColumn("side", F.lit(name)) for name, df in zip(("fit", "report"), lb.split_for_calibrator(held))]
    both = sides[0].unionByName(sides[1]).select("side", "match_id")
    per_match = both.groupBy("side", "match_id").agg(F.count(F.lit(1)).alias("n"))
    summary = per_match.groupBy("side").agg(
        F.sum("n").alias("side_rows"),
        F.count(F.lit(1)).alias("matches"),
        F.min("match_id").alias("first_match"),
        F.max("match_id").alias("last_match"),
    )
    shared = per_match.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    fact = F.when(shared.agg(F.count(F.lit(1))).scalar() == 0, "sides share no match").otherwise("a match is on both sides")
    return summary.withColumn("fact", fact)


_FACT_ROUNDS = 12
_FACT_CAP = 4


@query(
    f"""WITH {_HELD_SQL}, counts AS (SELECT count(*) FILTER (NOT held) AS train, count(*) FILTER (held) AS test,
      count(DISTINCT match_id) FILTER (held) AS matches FROM sides),
    every AS (SELECT count(*) AS n, count(*) FILTER (phase NOT IN {fv.SCOREABLE_PHASES}) AS neutral FROM ticks)
    SELECT 'train rows' AS fact, train AS amount FROM counts UNION ALL SELECT 'test rows', test FROM counts
    UNION ALL SELECT 'test matches', matches FROM counts UNION ALL SELECT 'predictions', n FROM every
    UNION ALL SELECT 'neutral predictions', neutral FROM every UNION ALL SELECT 'neutral predictions not 0.5', 0
    UNION ALL SELECT 'predictions outside 0..1', 0 UNION ALL SELECT 'held-out skill above 0', 1
    UNION ALL SELECT 'features with an importance', {len(fv.FEATURES)} UNION ALL SELECT 'importance in millionths off 1', 0
    UNION ALL SELECT 'unused features with a weight', 0 UNION ALL SELECT 'foreign feature order refused', 1
    UNION ALL SELECT 'margins off the first {_FACT_CAP} trees of the node table', 0
    UNION ALL SELECT 'predictions changed by storage', 0 UNION ALL SELECT 'calibrated predictions out of order', 0"""
)
def model_facts(spark, sf_dir):
    """What has to hold of a stored model whatever it learned: sides, neutral rows, importances, tree cap, calibration."""
    from roundcast.plans import model as md

    ticks = b.ticks(spark, sf_dir)
    made = md.train_model(_leaning(spark, sf_dir), num_rounds=_FACT_ROUNDS, params={"stepSize": 0.3}, calibrate=True)
    path = md.stored(made)
    model = md.load_model(spark, path)
    found = model.metadata
    every = md.predict(ticks, model)
    before = md.predict(ticks, made).select("match_id", "sequence", F.col("ct_win_probability").alias("was"))
    p = F.col("ct_win_probability")
    scored = every.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(~F.col("scored")).alias("neutral predictions"),
        F.count_if(~F.col("scored") & (p != fv.NEUTRAL_PROBABILITY)).alias("neutral predictions not 0.5"),
        F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("predictions outside 0..1"),
    ).first().asDict()
    # replays repeat a key with other columns, so both sides are compared as counted rows
    sides = every.select("match_id", "sequence", p.alias("p")), before.select("match_id", "sequence", F.col("was").alias("p"))
    changed = md.oftener(*sides, deal=("match_id", "sequence")).count()

    nodes = md.node_table(spark, path)
    gains = md.average_gain(nodes)
    used = {r["feature"] for r in nodes.filter("feature IS NOT NULL").select("feature").distinct().collect()}
    rows = feature_frame(_leaning(spark, sf_dir), ["match_id", "sequence"])
    cap = min(_FACT_CAP, found["model"]["trees"])
    short = md.cap_trees(model.pipeline, cap)
    both = md.capped_margin(md.capped_margin(rows, model.pipeline, nodes, cap, "whole"), short, nodes, cap)
    margin = F.get(md.vector_to_array("rawPrediction"), 1)
    far = (F.abs(margin - F.col("margin")) > 1e-9) | (F.abs(margin - F.col("whole")) > 1e-9)
    off = both.filter(far).count()
    try:
        md.check_contract(model.pipeline, fv.FEATURES[::-1])
        refused = 0
    except ValueError:
        refused = 1
    ys = model.breakpoints[1]
    facts = {
        "train rows": found["data"]["train"]["rows"],
        "test rows": found["data"]["test"]["rows"],
        "test matches": found["data"]["test"]["matches"],
        **scored,
        "held-out skill above 0": int(found["held_out"]["skill_score"] > 0),
        "features with an importance": len(gains),
        "importance in millionths off 1": int(abs(sum(gains.values()) - 1) * 1e6 / len(gains)),
        "unused features with a weight": sum(1 for name, share in gains.items() if share and name not in used),
        "foreign feature order refused": refused,
        f"margins off the first {_FACT_CAP} trees of the node table": off,
        "predictions changed by storage": changed,
        "calibrated predictions out of order": sum(a > b for a, b in zip(ys, ys[1:])),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in facts.items()], "fact string, amount long")


_SERVED_ROUNDS = 5
_FEED_TIE = ", ".join(f"{c} NULLS FIRST" for c in b.FEED if c not in ("match_id", "sequence"))
_FEED_SQL = f"""raw_feed AS ({projection(b.FEED, 'lineitem')}), ev AS (SELECT * FROM raw_feed
  QUALIFY row_number() OVER (PARTITION BY match_id, sequence ORDER BY {_FEED_TIE}) = 1)"""
_SERVED_SQL = f"""{_momentum_sql(_FEED_SQL, b.FEED_SPAN)}, served AS (
  SELECT ev.*, m.kills_ct AS kills_ct_window, m.kills_t AS kills_t_window, m.window_seconds
  FROM ev JOIN momentum m USING (match_id, sequence) WHERE phase IN {fv.SCOREABLE_PHASES})"""
_FEED_COLUMNS = [c for c in b.FEED if c not in ("match_id", "sequence", "timestamp", "event_type", "victim_team", "headshot")]


def _serve(spark, sf_dir, drain):
    """A stored model scores the feed, which lands in quarters of every match, one drain after each; gives model and feed."""
    from roundcast.plans import model as md
    from roundcast.session import checkpointed, scratch_path, use_utc
    from roundcast.streaming import jobs

    jobs.configure_state(use_utc(spark))
    model = md.load_model(spark, md.stored(md.train_model(_leaning(spark, sf_dir), num_rounds=_SERVED_ROUNDS, params={"stepSize": 0.3})))
    # A match lies in one file of each quarter: a drain may take several micro-batches, each of some of the files, and
    # rows of a match that come in another batch would be folded as late ones.
    rows = checkpointed(lb.dedupe(b.feed(spark, sf_dir)).repartition("match_id"))
    folder = scratch_path(spark, "feed")
    for quarter in range(4):
        rows.filter(F.floor(F.col("sequence") % 20_000 / 5_000) == quarter).write.mode("append").parquet(folder)
        events = jobs.read_table_stream(spark, folder, "*.parquet").withColumn("arrived", F.col("_metadata.file_modification_time"))
        drain(
            jobs.score_stream(
                events,
                md.scorer(model),
                _FEED_COLUMNS,
                keep=("round_number", "arrived"),
                with_features=True,
                span_seconds=b.FEED_SPAN,
            )
        )
    return model, spark.read.parquet(folder)


@query(
    f"""WITH {_SERVED_SQL} SELECT match_id, sequence, round_number, true AS as_in_batch,
    {", ".join(f"CAST({text} AS DOUBLE) AS {name}" for name, text in _FEATURE_SQL.items())} FROM served"""
)
def stream_model_scoring(spark, sf_dir):
    """Features and predictions of a stored model in the stream, beside the batch prediction of the same tick."""
    from roundcast.plans import model as md
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "served")
    model, feed = _serve(spark, sf_dir, lambda out: jobs.run_to_end(out, path, log, state_partitions=_cores(spark)))
    windows = mo.momentum(feed, span_seconds=b.FEED_SPAN, keep=_FEED_COLUMNS).withColumnsRenamed(
        {"kills_ct": "kills_ct_window", "kills_t": "kills_t_window"}
    )
    batch = md.predict(windows, model).filter("scored").select("match_id", "sequence", F.col("ct_win_probability").alias("batch"))
    near = F.coalesce(F.abs(F.col("ct_win_probability") - F.col("batch")) <= 1e-6, F.lit(False))
    both = spark.read.parquet(path).join(batch, ["match_id", "sequence"], "full")
    return both.select("match_id", "sequence", "round_number", near.alias("as_in_batch"), *fv.FEATURES)


@query(
    f"""WITH {_SERVED_SQL} SELECT match_id, max(sequence) AS sequence, arg_max(round_number, sequence) AS round_number,
    count(*) AS published, count(*) AS complete FROM served GROUP BY match_id"""
)
def stream_model_predictions(spark, sf_dir):
    """Last prediction of every match from the published payloads; complete ones have all nine fields and add up to 1."""
    from roundcast.streaming import jobs

    path, log = jobs.scratch_pair(spark, "published")

    def drain(out):
        jobs.run_to_end(jobs.prediction_messages(out), path, log, state_partitions=_cores(spark))

    _serve(spark, sf_dir, drain)
    read = jobs.read_predictions(spark.read.parquet(path))
    filled = reduce(lambda a, c: a & c, [F.col(c).isNotNull() for c in read.columns])
    whole = filled & (F.abs(F.col("ct_win_probability") + F.col("t_win_probability") - 1) < 2e-6) & (F.col("latency_ms") >= 0)
    return read.groupBy("match_id").agg(
        F.max("sequence").alias("sequence"),
        F.max_by("round_number", "sequence").alias("round_number"),
        F.count(F.lit(1)).alias("published"),
        F.count_if(whole).alias("complete"),
    )


@query()
def feature_gains(spark, sf_dir):
    """Average gain per split of each feature, beside its share of the total gain."""
    from roundcast.plans import model as md

    model = md.train_model(_leaning(spark, sf_dir), num_rounds=_FACT_ROUNDS, params={"stepSize": 0.3})
    gains = md.average_gain(md.node_table(spark, md.stored(model)))
    total = model.metadata["model"]["importance"]
    return spark.createDataFrame(
        [(name, share, total[name]) for name, share in gains.items()], "feature string, average_gain double, total_gain double"
    )


@query()
def gbt_train(spark, sf_dir):
    from roundcast.plans.model import train_model

    model = train_model(_leaning(spark, sf_dir))
    found = model.metadata
    shares = list(found["model"]["importance"].items())
    out = spark.createDataFrame(shares, "feature string, importance double")
    return out.withColumns(
        {
            "trees": F.lit(found["model"]["trees"]),
            "skill_score": F.lit(found["held_out"]["skill_score"]),
            "train_rows": F.lit(found["data"]["train"]["rows"]),
        }
    )


@query()
def gbt_score(spark, sf_dir):
    from roundcast.plans.model import load_model, predict, stored, train_model

    model = load_model(spark, stored(train_model(_leaning(spark, sf_dir))))
    return predict(b.ticks(spark, sf_dir), model)


@query()
def validate_pipeline(spark, sf_dir):
    from roundcast.plans.model import train_model, validate

    frame = _leaning(spark, sf_dir)
    reports = validate(frame, train_model(frame))
    bench = reports["benchmark"].select(
        F.lit("situation").alias("part"), "name", F.col("skill_score").alias("score")
    )
    drift = reports["drift"].select(
        F.lit("drift").alias("part"), F.col("feature").alias("name"), F.col("psi").alias("score")
    )
    return bench.unionByName(drift)
