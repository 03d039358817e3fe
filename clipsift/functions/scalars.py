"""Scalar expressions on intervals, scores and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two intervals over their hull; 0 where the hull is empty."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, shared / hull).otherwise(F.lit(0.0))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap: touching intervals don't."""
    return (a_end > b_start) & (a_start < b_end)


def rating(x: Column) -> Column:
    """A 1 to 5 rating on -1 to 1; a missing one is neutral."""
    return (F.coalesce(x, F.lit(3.0)) - 3.0) / 2.0


def centred(share: Column) -> Column:
    """A 0 to 1 share on -1 to 1; a missing one is neutral."""
    return 2.0 * F.coalesce(share, F.lit(0.5)) - 1.0


def preference_vector(hook: Column, completeness: Column, payoff: Column, clarity: Column, duration: Column, urgency: Column, excitement: Column) -> list[Column]:
    """Seven features of a clip that preferences are learned on."""
    return [rating(hook), rating(completeness), rating(payoff), rating(clarity), (duration - 40.0) / 20.0, centred(urgency), centred(excitement)]


#: Preferred seconds and weights (duration, hook, completeness, payoff, clarity, urgency, excitement) of each platform.
PLATFORMS: dict[str, tuple[float, tuple[float, ...]]] = {
    "youtube": (45.0, (0.050, 0.025, 0.030, 0.035, 0.020, 0.010, 0.010)),
    "instagram": (32.0, (0.050, 0.035, 0.015, 0.020, 0.020, 0.025, 0.045)),
    "tiktok": (25.0, (0.060, 0.050, 0.010, 0.020, 0.010, 0.045, 0.045)),
}
PLATFORM_CAP = 0.18


def by_platform(platform: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(platform == name, F.lit(value)).otherwise(out)
    return out


def platform_adjustment(platform: Column, ratings: Sequence[Column], duration: Column, urgency: Column, excitement: Column) -> Column:
    """A bounded prior of a platform for a clip: seven weighted terms."""
    fit = F.greatest(F.lit(-1.0), 1.0 - F.abs(duration - by_platform(platform, {p: v[0] for p, v in PLATFORMS.items()})) / 25.0)
    terms = [fit, *map(rating, ratings), centred(urgency), centred(excitement)]
    total = F.lit(0.0)
    for k, term in enumerate(terms):
        total = total + by_platform(platform, {p: v[1][k] for p, v in PLATFORMS.items()}) * term
    return clamp(total, -PLATFORM_CAP, PLATFORM_CAP)


def shrink(n: Column, prior: float) -> Column:
    """Trust in n examples against a prior worth ``prior`` of them."""
    return n / (n + F.lit(prior))


def cap_jointly(a: Column, b: Column, cap: float) -> tuple[Column, Column]:
    """Both scaled alike where their sum passes the cap."""
    scale = F.when(F.abs(a + b) > cap, F.lit(cap) / F.abs(a + b)).otherwise(F.lit(1.0))
    return a * scale, b * scale


def six(x: Column) -> Column:
    """Six decimals, the precision of every double that a query returns; -0 becomes 0."""
    return F.round(x.cast("double"), 6) + F.lit(0.0)


def six_plain(x: Column) -> Column:
    """``six`` of a double without its decimal digits: whole millionths over a million, but for what is large or lies near a tie.

    Rounding a double takes Spark a decimal number each time, which costs more than most of what is rounded.
    """
    millionths = x * 1e6
    whole = F.rint(millionths)
    return F.when((F.abs(x) < 1e6) & (F.abs(millionths - whole) < 0.49), whole / 1e6 + F.lit(0.0)).otherwise(six(x))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is found once a row. A plain column can be replaced by its expression wherever a lambda names it, and is then found for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)
