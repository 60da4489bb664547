"""The canon: the names of ideas that every archive knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in the data's own order.
CANON = (
    "Attention", "Memory", "Learning", "Reasoning", "Judgment", "Creativity", "Curiosity", "Intuition", "Bias", "Uncertainty", "Expertise",
    "Teachability", "Identity", "Emotion", "Motivation", "Habit", "Discipline", "Anxiety", "Resilience", "Purpose", "Authenticity", "Vulnerability",
    "Desire", "Consciousness", "Acceptance", "Self-Compassion", "Sufficiency", "Truth", "Evidence", "Explanation", "Language", "Narrative", "Models",
    "Information", "Complexity", "Emergence", "Systems", "Causation", "Probability", "Understanding", "Externalized Cognition", "Decision",
    "Strategy", "Risk", "Mastery", "Failure", "Innovation", "Feedback", "Incentives", "Leadership", "Collaboration", "Productivity",
    "Decision Quality", "Positioning", "Justice", "Freedom", "Equality", "Power", "Authority", "Institutions", "Markets", "Inequality", "Democracy",
    "Trust", "Status", "Conflict", "Cooperation", "Representation", "Restitution", "Love", "Friendship", "Community", "Care", "Empathy",
    "Obligation", "Morality", "Virtue", "Forgiveness", "Time", "Change", "Progress", "History", "Growth", "Entropy", "Cycles", "Future", "Nature",
    "Life", "Evolution", "Energy", "Beauty", "Art", "Play", "Wonder", "Suffering", "Death", "the Sacred",
)


def canon(spark: SparkSession) -> DataFrame:
    """name, lowered: a row for each idea."""
    return spark.createDataFrame([(name, name.lower()) for name in CANON], "name string, lowered string")
