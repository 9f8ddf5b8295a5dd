"""The look-ups that services make row by row, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reminder_context(reminders: DataFrame, users: DataFrame, analyses: DataFrame, vault: DataFrame) -> DataFrame:
    """Each reminder with its user (without one it is left out), its analysis if there is one, and its document's vault rows as an array."""
    owners = users.select(F.col("id").alias("user_id"), "channel", "channel_user_id", "locale")
    of = analyses.select(F.col("id").alias("analysis_id"), "document_id", "authority", "deadline", "risk_level")
    rows = vault.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("token", "entity_type", "ciphertext", "iv", "auth_tag"))).alias("vault"))
    return reminders.join(owners, "user_id").join(of, "analysis_id", "left").join(rows, "document_id", "left")


def draft_context(analyses: DataFrame, documents: DataFrame, vault: DataFrame) -> DataFrame:
    """Each analysis with its document and vault rows; the owner that opens them is the document's, never the caller's."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("user_id").alias("owner_id"), "masked_text")
    rows = vault.groupBy("document_id").agg(F.collect_list(F.struct("token", "entity_type", "ciphertext", "iv", "auth_tag")).alias("vault"))
    return analyses.join(docs, "document_id").join(rows, "document_id", "left")


def notified_watches(watches: DataFrame, users: DataFrame) -> DataFrame:
    """Watches with whom to tell; those without a user are silently left out."""
    return watches.join(users.select(F.col("id").alias("user_id"), "channel", "channel_user_id", "locale"), "user_id")


def evaluation_cases(letters: DataFrame, expected: DataFrame, profiles: DataFrame) -> DataFrame:
    """Letters with what is expected of them, and a profile where there is one, by case key."""
    return letters.join(expected, "case_key").join(profiles, "case_key", "left")


def listed_overlap(wanted: str, got: str):
    """How many wanted entries have one that holds the first eight characters of the other, letter case aside."""
    near = lambda w, g: F.contains(F.lower(g), F.substring(F.lower(w), 1, 8)) | F.contains(F.lower(w), F.substring(F.lower(g), 1, 8))
    return F.size(F.filter(F.col(wanted), lambda w: F.exists(F.col(got), lambda g: near(w, g))))
