"""Court and play predicates as Column expressions (centimetres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import BASELINE_TO_RIM, COURT_LENGTH, COURT_WIDTH, RIM_RADIUS, RIM_Z, THREE_POINT


def _distance(x: Column, y: Column, to_x: Column | float, to_y: Column | float) -> Column:
    return F.sqrt((x - to_x) * (x - to_x) + (y - to_y) * (y - to_y))


def rim_x(left: Column) -> Column:
    """x of the left or right rim."""
    return F.when(left, F.lit(BASELINE_TO_RIM)).otherwise(F.lit(COURT_LENGTH - BASELINE_TO_RIM))


def in_rim(x: Column, y: Column, z: Column) -> Column:
    """Whether a ball is in either rim: within its radius, and less than 10 from its height."""
    near = lambda left: _distance(x, y, rim_x(F.lit(left)), COURT_WIDTH / 2) < RIM_RADIUS
    return (F.abs(z - RIM_Z) < 10.0) & (near(True) | near(False))


def out_of_bounds(x: Column, y: Column) -> Column:
    """Whether a point is off the court."""
    return (x < 0) | (x > COURT_LENGTH) | (y < 0) | (y > COURT_WIDTH)


def three_point_attempt(x: Column, y: Column, left: Column) -> Column:
    """Whether a point is farther than the three-point radius from the target rim."""
    return _distance(x, y, rim_x(left), COURT_WIDTH / 2) > THREE_POINT


def zone(x: Column, y: Column, left: Column) -> Column:
    """The court zone, seen from the target basket: half, then paint, then what lies beyond the three-point line."""
    from_baseline = F.when(left, x).otherwise(COURT_LENGTH - x)
    aside = F.abs(y - COURT_WIDTH / 2)
    beyond = _distance(x, y, rim_x(left), COURT_WIDTH / 2) > THREE_POINT
    flank = F.concat(F.when(beyond & (from_baseline < 300.0), "Corner").otherwise("Wing"), F.when(y < COURT_WIDTH / 2, "Left").otherwise("Right"))
    return (
        F.when(from_baseline > COURT_LENGTH / 2, "Backcourt")
        .when((from_baseline < 580.0) & (aside < 245.0), "Paint")
        .when(beyond & (from_baseline >= 300.0) & (aside < 300.0), "TopOfKey")
        .otherwise(flank)
    )


def blocking_path(hand: tuple[Column, Column, Column], ball: tuple[Column, Column, Column]) -> Column:
    """Whether a hand is within 20 of the ball and not more than 10 below it."""
    d = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(hand[1:], ball[1:], strict=True)), (hand[0] - ball[0]) * (hand[0] - ball[0])))
    return (d < 20.0) & (hand[2] >= ball[2] - 10.0)


def shot_release(vz_before: Column, vz: Column, z: Column) -> Column:
    """Whether vertical speed jumps by more than 100 above a height of 150."""
    return (F.abs(vz - vz_before) > 100.0) & (z > 150.0)


def rebound_opportunity(z: Column) -> Column:
    """Whether a ball is less than 50 from the rims' height."""
    return F.abs(z - RIM_Z) < 50.0


def is_ball(class_id: Column, class_name: Column) -> Column:
    """Class 32, or a name that is ``sports_ball`` once lower-cased and spaces are underscores."""
    return F.coalesce(class_id == 32, F.lit(False)) | F.coalesce(F.replace(F.lower(F.trim(class_name)), F.lit(" "), F.lit("_")) == "sports_ball", F.lit(False))
