"""Device lexicon used by the decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Command phrases per device family.
LEXICON = {
    "tv": ["volume up", "volume down", "mute", "unmute", "channel up", "channel down", "play", "pause", "stop", "next", "previous", "rewind",
           "fast forward", "open app", "switch input", "power on", "power off"],
    "robot vacuum": ["start", "pause", "stop", "resume", "go home", "spot clean", "zone clean"],
    "air conditioner": ["temperature up", "temperature down", "cool", "heat", "dehumidify", "auto", "fan higher", "fan lower", "strong", "sleep", "turbo"],
    "washer": ["start", "pause", "cancel", "add rinse", "add spin", "start dry", "time dry", "air dry", "gentle", "strong"],
    "dishwasher": ["standard", "heavy", "eco", "sanitize", "quick", "dry boost", "delay start", "schedule", "cancel"],
    "oven": ["preheat", "bake", "roast", "air fry", "start", "stop"],
    "refrigerator": ["power cool", "power freeze", "fridge temperature", "freezer temperature", "refill mode", "memo", "shopping"],
}
FAMILIES = list(LEXICON)
PHRASES = [p for f in FAMILIES for p in LEXICON[f]]
ROOMS = ["living room", "kitchen", "bedroom"]


def lexicon_table(spark: SparkSession) -> DataFrame:
    """(family, entry): a fixed dimension of a few dozen rows."""
    return spark.createDataFrame([(f, e) for f in FAMILIES for e in LEXICON[f]], "family string, entry string")


def matching_table(spark: SparkSession) -> DataFrame:
    """(family, kind, entry): each family's own entries are active, those of the others defensive."""
    rows = [(f, "active" if f == g else "defensive", e) for f in FAMILIES for g in FAMILIES for e in LEXICON[g]
            if f == g or e not in LEXICON[f]]
    return spark.createDataFrame(rows, "family string, kind string, entry string")
