"""Vocabularies, limits and thresholds that define the results.

Everything here is data that has to be exactly so for results to be right.
"""

from __future__ import annotations

# --- Fixed values: vocabularies ------------------------------------------------
TEAMS = ("CT", "T")
PHASES = ("freezetime", "live", "bomb_planted", "over")
SCOREABLE_PHASES = ("live", "bomb_planted")
ROUND_END_REASONS = (
    "ct_eliminated",
    "t_eliminated",
    "bomb_defused",
    "bomb_exploded",
    "time_expired",
)
REASONS_ONLY_CT_WINS = ("t_eliminated", "bomb_defused", "time_expired")
REASONS_ONLY_T_WINS = ("ct_eliminated", "bomb_exploded")
EVENT_TYPES = (
    "match_start",
    "round_start",
    "tick",
    "kill",
    "bomb_planted",
    "bomb_defused",
    "round_end",
    "match_end",
)
MAPS = (
    "de_dust2",
    "de_mirage",
    "de_inferno",
    "de_nuke",
    "de_overpass",
    "de_ancient",
    "de_anubis",
)

# --- Fixed values: weapon prices, display names and who may buy what -----------
WEAPON_COST = {
    "knife": 0,
    "glock": 0,
    "usp": 0,
    "p250": 300,
    "deagle": 700,
    "mac10": 1050,
    "mp9": 1250,
    "ump45": 1200,
    "galil": 1800,
    "famas": 2050,
    "ak47": 2700,
    "m4a4": 3100,
    "m4a1s": 2900,
    "awp": 4750,
    "sg553": 3000,
    "aug": 3300,
}
WEAPON_LABEL = {
    "knife": "Knife",
    "glock": "Glock-18",
    "usp": "USP-S",
    "p250": "P250",
    "deagle": "Desert Eagle",
    "mac10": "MAC-10",
    "mp9": "MP9",
    "ump45": "UMP-45",
    "galil": "Galil",
    "famas": "FAMAS",
    "ak47": "AK-47",
    "m4a4": "M4A4",
    "m4a1s": "M4A1-S",
    "awp": "AWP",
    "sg553": "SG 553",
    "aug": "AUG",
}
SIDE_WEAPONS = {
    "CT": (
        "knife", "usp", "p250", "deagle", "mp9", "ump45", "famas", "m4a4", "m4a1s", "aug", "awp",
    ),
    "T": ("knife", "glock", "p250", "deagle", "mac10", "galil", "ak47", "sg553", "awp"),
}
REASON_LABEL = {
    "ct_eliminated": "CT eliminated",
    "t_eliminated": "T eliminated",
    "bomb_defused": "bomb defused",
    "bomb_exploded": "bomb detonated",
    "time_expired": "time expired",
}
KEVLAR_COST = 650
KEVLAR_HELMET_COST = 1_000
DEFUSE_KIT_COST = 400

# --- Fixed values: match rules --------------------------------------------------
ROUNDS_TO_WIN = 13
REGULATION_ROUNDS = 24
PLAYERS_PER_TEAM = 5
ROUND_SECONDS = 115.0
BOMB_SECONDS = 40.0
MAX_MONEY = 16_000
MAX_HEALTH = 100
MAX_ARMOUR = 100
MAX_ROUND_NUMBER = 64
MAX_SCORE = 64
MAX_PLAYERS = 32
MAX_NAME = 64
POSITION_LIMIT = {"x": 8192.0, "y": 8192.0, "z": 2048.0}
LOSS_LADDER = (1_400, 1_900, 2_400, 2_900, 3_400)
FULL_BUY_PER_PLAYER = 4_000
SCHEMA_VERSION = "1.0"

# --- Fixed values: windows, retention and thresholds ----------------------------
MOMENTUM_SECONDS = 15.0
STATE_TTL_SECONDS = 3_600
RETAINED_ROUNDS = 64
FRAME_INTERVAL_SECONDS = 0.25
TIMELINE_POINTS = 600
ROUND_LOG_ROWS = 32
LATENCY_SAMPLES = 1_000
STABILITY_SAMPLES = 8
STABILITY_MINIMUM = 3
VOLATILITY_SCALE = 0.15
SUPPORT_SIGMAS = 3.0
BAND_HIGH = 0.66
BAND_MEDIUM = 0.33
EVEN_MARGIN = 0.01
NEUTRAL_PROBABILITY = 0.5
PSI_BINS = 10
PSI_STABLE = 0.10
PSI_SHIFTED = 0.25
DRIFT_MIN_ROWS = 200
DRIFT_MIN_DISTINCT = 30
DRIFT_SAMPLE_ROWS = 20_000
DRIFT_EPSILON = 1e-6
CALIBRATION_BINS = 10
CALIBRATION_TOLERANCE = 0.05
CALIBRATOR_MIN_ROWS = 100
CALIBRATOR_GRID = 256
CALIBRATION_MIN_MATCHES = 6
MIN_SLICE_ROWS = 50
LOG_LOSS_EPSILON = 2.220446049250313e-16

# --- Fixed values: model input, in training order -------------------------------
FEATURES = (
    "alive_ct",
    "alive_t",
    "alive_delta",
    "alive_ratio",
    "health_ratio",
    "time_fraction",
    "bomb_planted",
    "bomb_time_fraction",
    "money_ratio",
    "equipment_ratio",
    "loss_streak_delta",
    "score_delta",
    "round_fraction",
    "kill_delta_window",
    "engagement_pace",
)
