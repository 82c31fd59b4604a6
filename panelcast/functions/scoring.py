"""The rulebook and the expectations built on it, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scoring rules.
POSITIONS = ("GK", "DEF", "MID", "FWD")
GOAL_POINTS = {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4}
ASSIST_POINTS = 3
CLEAN_SHEET_POINTS = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
FULL_MINUTES = 60
SAVES_PER_POINT = 3
PENALTY_SAVE_POINTS = 5
PENALTY_MISS_POINTS = -2
CONCEDED_PER_POINT = 2
YELLOW_CARD_POINTS = -1
RED_CARD_POINTS = -3
OWN_GOAL_POINTS = -2
ACTIONS_THRESHOLD = {"GK": 12, "DEF": 10, "MID": 12, "FWD": 12}
ACTIONS_POINTS = 2
CONCEDING_POSITIONS = ("GK", "DEF")
POINTS_TERMS = (
    "appearance", "goals", "assists", "clean_sheet", "goals_conceded", "saves", "defcon", "bonus", "cards",
)
ACTUAL_TERMS = (*POINTS_TERMS, "other")

# Live-feed identifier to scoring term; an unknown one counts as "other".
IDENTIFIER_TO_TERM = {
    "minutes": "appearance", "goals_scored": "goals", "assists": "assists", "clean_sheets": "clean_sheet",
    "goals_conceded": "goals_conceded", "saves": "saves", "penalties_saved": "saves",
    "defensive_contribution": "defcon", "bonus": "bonus", "yellow_cards": "cards", "red_cards": "cards",
    "own_goals": "other", "penalties_missed": "other",
}


def by_position(position: Column, table: Mapping[str, int], default: int = 0) -> Column:
    """A literal per-position value; one map lookup inside code generation."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), position), F.lit(default))


def appearance_points(minutes: Column) -> Column:
    return F.when(minutes >= FULL_MINUTES, 2).when(minutes > 0, 1).otherwise(0)


def clean_sheet_points(position: Column, minutes: Column, clean: Column) -> Column:
    return F.when(clean & (minutes >= FULL_MINUTES), by_position(position, CLEAN_SHEET_POINTS)).otherwise(0)


def goals_conceded_points(position: Column, conceded: Column) -> Column:
    return F.when(position.isin(*CONCEDING_POSITIONS), -F.floor(conceded / CONCEDED_PER_POINT)).otherwise(0)


def saves_points(saves: Column) -> Column:
    return F.floor(saves / SAVES_PER_POINT)


def actions_points(position: Column, actions: Column) -> Column:
    reached = actions >= by_position(position, ACTIONS_THRESHOLD, 12)
    return F.when(reached, ACTIONS_POINTS).otherwise(0)


def score(s: Mapping[str, Column]) -> Column:
    """Points of a stat line. Absent entries count as zero; without minutes nothing counts."""
    def at(name: str) -> Column:
        return F.coalesce(s[name], F.lit(0)) if name in s else F.lit(0)

    position, minutes = s["position"], at("minutes")
    clean = F.coalesce(s["clean_sheet"], F.lit(False)) if "clean_sheet" in s else F.lit(False)
    total = (
        appearance_points(minutes)
        + at("goals_scored") * by_position(position, GOAL_POINTS)
        + at("assists") * ASSIST_POINTS
        + clean_sheet_points(position, minutes, clean)
        + goals_conceded_points(position, at("goals_conceded"))
        + saves_points(at("saves"))
        + at("penalties_saved") * PENALTY_SAVE_POINTS
        + at("penalties_missed") * PENALTY_MISS_POINTS
        + actions_points(position, at("defensive_contribution"))
        + at("yellow_cards") * YELLOW_CARD_POINTS
        + at("red_cards") * RED_CARD_POINTS
        + at("own_goals") * OWN_GOAL_POINTS
        + at("bonus")
    )
    return F.when(minutes > 0, total).otherwise(0).cast("bigint")


def poisson_step(rate: Column, per: int = 2, cap: int = 24) -> Column:
    """E[floor(X / per)] for X ~ Poisson(rate), as one polynomial in the rate.

    The coefficients are constants known when the plan is made, so the row only pays for a Horner
    evaluation and one exponential.
    """
    rate = F.when(rate.isNotNull(), F.greatest(rate, F.lit(1e-9)))
    poly = F.lit(0.0)
    for k in range(cap, -1, -1):
        poly = poly * rate + F.lit((k // per) / math.factorial(k))
    return poly * F.exp(-rate)


def availability_ceiling(p: Column, flag: Column) -> Column:
    """A probability capped by the published availability in percent; unflagged rows are left alone."""
    share = unit(flag / 100.0)
    return F.when(p.isNotNull(), F.least(p, F.coalesce(share, F.lit(1.0))))


def unit(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def reconcile(p_full: Column, p_play: Column) -> Column:
    """Playing the full threshold implies playing."""
    return F.when(p_full.isNotNull() & p_play.isNotNull(), F.least(p_full, p_play))


def combine(f: Mapping[str, Column], yellow_rate: Column | None = None, red_rate: Column | None = None) -> dict[str, Column]:
    """Expected points by term. Each term uses the playing-time probability its rule depends on."""
    position, p_play, p_60 = f["position"], f["p_play"], f["p_60"]
    conceding = position.isin(*CONCEDING_POSITIONS)
    terms = {
        "appearance": p_play + p_60,
        "goals": f["expected_goals"] * by_position(position, GOAL_POINTS),
        "assists": f["expected_assists"] * ASSIST_POINTS,
        "clean_sheet": f["p_clean_sheet"] * p_60 * by_position(position, CLEAN_SHEET_POINTS),
        "goals_conceded": F.when(conceding, -f["conceded_penalty"] * p_60).otherwise(0.0),
        "saves": f["expected_save_points"],
        "defcon": f["p_defcon"] * ACTIONS_POINTS,
        "bonus": f["expected_bonus"],
        "cards": F.lit(0.0),
    }
    if yellow_rate is not None and red_rate is not None:
        cards = F.coalesce(yellow_rate, F.lit(0.0)) * YELLOW_CARD_POINTS + F.coalesce(red_rate, F.lit(0.0)) * RED_CARD_POINTS
        terms["cards"] = cards * p_play
    total = F.lit(0.0)
    for name in POINTS_TERMS:
        total = total + terms[name]
    return {**terms, "expected_points": total}


def stat_line_text(s: Mapping[str, Column]) -> Column:
    """What happened in one line, such as `90' G 2A CS 3b`; absent parts are skipped."""
    def whole(name: str) -> Column:
        return F.coalesce(s[name], F.lit(0)).cast("bigint")

    def counted(n: Column, letter: str) -> Column:
        return F.when(n == 1, F.lit(letter)).when(n != 0, F.concat(n.cast("string"), F.lit(letter)))

    minutes, saves, bonus, other = whole("minutes"), whole("saves"), whole("bonus"), whole("act_other")
    bits = F.concat_ws(
        " ", F.concat(minutes.cast("string"), F.lit("'")),
        counted(whole("goals"), "G"), counted(whole("assists"), "A"),
        F.when(F.coalesce(s["act_clean_sheet"], F.lit(0)) != 0, F.lit("CS")),
        F.when((s["position"] == "GK") & (saves >= 3), F.concat(saves.cast("string"), F.lit("sv"))),
        F.when(F.coalesce(s["act_defcon"], F.lit(0)) != 0, F.lit("DC")),
        F.when(bonus != 0, F.concat(bonus.cast("string"), F.lit("b"))),
        F.when(whole("yellow") != 0, F.lit("YC")), F.when(whole("red") != 0, F.lit("RC")),
        F.when(other != 0, F.concat(F.when(other > 0, F.lit("+")).otherwise(F.lit("")), other.cast("string"), F.lit(" other"))),
    )
    return F.when(minutes == 0, F.lit("did not play")).otherwise(bits)


def chip_key(name: Column, period: Column, first_half_last: int = 19) -> Column:
    return F.concat(F.when(period <= first_half_last, F.lit("1")).otherwise(F.lit("2")), F.lit(":"), name)
