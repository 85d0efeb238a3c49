"""Business labels: which name a segment, priority or action gets.

The words and thresholds below are fixed values that other tools match on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names.
CHAMPIONS = "Champions"
AT_RISK = "At-Risk High Value"
LOYAL_LOW = "Loyal Low Spend"
NEW = "New Customers"
OCCASIONAL = "Occasional Shoppers"
UNKNOWN = "Unknown"

# Objective and recommended actions per segment.
PLAYBOOK = [
    (
        CHAMPIONS,
        "Reward & retain",
        "VIP perks, early access, premium bundles, referral incentives.",
    ),
    (
        AT_RISK,
        "Win-back",
        "Triggered email + time-limited offer, personalised recommendations, free shipping.",
    ),
    (
        LOYAL_LOW,
        "Increase basket size",
        "Cross-sell bundles, threshold-based discounts, subscribe-and-save style offers.",
    ),
    (
        NEW,
        "Onboard & convert",
        "Welcome journey, product education, second-purchase incentive within 7-14 days.",
    ),
    (
        OCCASIONAL,
        "Reactivate gently",
        "Seasonal campaigns, reminders, category-based promos, social proof/reviews.",
    ),
]

# Labels by (risk tile, value tile), 1 being the highest tile.
# The list and the scores use different words for the same three levels.
LIST_LABELS = {(1, 1): "HIGH PRIORITY", (1, 2): "MEDIUM PRIORITY", (2, 1): "MEDIUM PRIORITY"}
LIST_DEFAULT = "LOW PRIORITY"
LIST_ACTIONS = {
    (1, 1): "Immediate retention offer: personalised incentive, free shipping, or VIP outreach.",
    (1, 2): "Triggered email + reminder + category-based recommendations.",
    (2, 1): "Soft engagement: loyalty points, content-based nudges.",
}
ACTION_DEFAULT = "Low-cost, broad campaigns only."
BAND_LABELS = {(1, 1): "HIGH", (1, 2): "MEDIUM", (2, 1): "MEDIUM"}
BAND_DEFAULT = "LOW"


def by_tiles(risk: Column, value: Column, labels: dict, default: str) -> Column:
    """Label looked up by the pair of tiles."""
    picked = [
        F.when((risk == risk_tile) & (value == value_tile), label)
        for (risk_tile, value_tile), label in labels.items()
    ]
    return F.coalesce(*picked, F.lit(default))


def segment_name(recency_rank: Column, value_rank: Column, freq_rank: Column) -> Column:
    """Segment name from dense ranks (1 = most recent, most valuable, most frequent).

    The first rule that fits wins.  The thresholds are fixed values.
    """
    return (
        F.when((value_rank == 1) & (freq_rank <= 2) & (recency_rank <= 2), CHAMPIONS)
        .when((value_rank <= 2) & (recency_rank >= 4), AT_RISK)
        .when((freq_rank <= 2) & (value_rank >= 4), LOYAL_LOW)
        .when((recency_rank <= 2) & (freq_rank >= 4), NEW)
        .otherwise(OCCASIONAL)
    )
