"""The record tables as pure functions from tables to tables: look-ups, changes, expiry, cascades and guarded states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import utc_date

#: Tables in the order in which expired rows go; watches are left alone unless asked for.
PURGE_ORDER = ("pii_vault", "drafts", "analyses", "reminders", "documents", "users")
#: Every foreign key as child table, column and parent table, parents first. Audit rows stay and lose their user.
CASCADE = (
    ("documents", "user_id", "users"), ("analyses", "document_id", "documents"), ("drafts", "analysis_id", "analyses"), ("reminders", "user_id", "users"), ("reminders", "analysis_id", "analyses"),
    ("pii_vault", "user_id", "users"), ("pii_vault", "document_id", "documents"), ("watches", "user_id", "users"),
)


#: The record tables' columns.
SCHEMAS: Mapping[str, str] = {
    "users": "id string, channel string, channel_user_id string, locale string, consent_at timestamp, profile_completed_at timestamp, created_at timestamp, updated_at timestamp, delete_after timestamp",
    "documents": "id string, user_id string, kind string, status string, masked_text string, mime string, size_bytes int, created_at timestamp, updated_at timestamp, delete_after timestamp",
    "analyses": "id string, document_id string, authority string, request_type string, summary string, deadline date, risk_level string, missing_documents array<struct<label:string,explanation:string,where_to_get:string,required:boolean>>, next_steps array<string>, confidence decimal(3,2), created_at timestamp, updated_at timestamp, delete_after timestamp",
    "drafts": "id string, analysis_id string, subject string, body string, status string, approved_at timestamp, rejected_at timestamp, sent_at timestamp, created_at timestamp, updated_at timestamp, delete_after timestamp",
    "reminders": "id string, user_id string, analysis_id string, due_date timestamp, status string, sent_at timestamp, created_at timestamp, updated_at timestamp, delete_after timestamp",
    "pii_vault": "id string, user_id string, document_id string, token string, entity_type string, ciphertext string, iv string, auth_tag string, key_version int, created_at timestamp, delete_after timestamp",
    "audit_log": "id string, user_id string, action string, detail map<string,string>, created_at timestamp",
    "watches": "id string, user_id string, url string, status string, check_count int, last_checked_at timestamp, found_at timestamp, error_message string, created_at timestamp, updated_at timestamp, delete_after timestamp",
}

#: What enumerated columns may hold.
ENUMS = {
    ("documents", "status"): ("received", "processing", "analyzed", "failed"), ("analyses", "risk_level"): ("low", "medium", "high", "critical"),
    ("drafts", "status"): ("draft", "pending_approval", "approved", "rejected", "sent"), ("reminders", "status"): ("scheduled", "sent", "cancelled"), ("watches", "status"): ("active", "found", "paused", "error"),
}


def by_id(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key, if there is one."""
    return table.where(F.col(key) == value).limit(1)


def by_all(table: DataFrame, **values: object) -> DataFrame:
    """Rows that equal every value given."""
    for k, v in values.items():
        table = table.where(F.col(k) == v)
    return table


def upcoming(analyses: DataFrame, before: Column, deadline: str = "deadline") -> DataFrame:
    """Rows whose deadline's date is not after before's UTC date, soonest first."""
    return analyses.where(F.col(deadline).isNotNull() & (F.col(deadline) <= utc_date(before))).orderBy(deadline)


def due(reminders: DataFrame, now: Column) -> DataFrame:
    """Scheduled reminders due now or before, soonest first."""
    return reminders.where((F.col("status") == "scheduled") & (F.col("due_date") <= now)).orderBy("due_date")


def sent(reminders: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(reminders with those due marked as sent at now, those that were due): what a tick of the clock does."""
    is_due = (F.col("status") == "scheduled") & (F.col("due_date") <= now)
    hit = F.coalesce(is_due, F.lit(False))
    return reminders.withColumns({"sent_at": F.when(hit, now).otherwise(F.col("sent_at")), "status": F.when(hit, "sent").otherwise(F.col("status"))}), due(reminders, now)


def decided(drafts: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """drafts after decisions (draft_id, approve): one that is pending gets its state and the time of it; any other stays as it is."""
    d = decisions.groupBy("draft_id").agg(F.bool_and("approve").alias("__approve"))
    joined = drafts.join(d, F.col("id") == F.col("draft_id"), "left")
    hit = F.coalesce((F.col("status") == "pending_approval") & F.col("__approve").isNotNull(), F.lit(False))
    return joined.withColumns(
        {
            "approved_at": F.when(hit & F.col("__approve"), now).otherwise(F.col("approved_at")), "rejected_at": F.when(hit & ~F.col("__approve"), now).otherwise(F.col("rejected_at")),
            "status": F.when(hit, F.when(F.col("__approve"), "approved").otherwise("rejected")).otherwise(F.col("status")),
        }
    ).drop("draft_id", "__approve")


def profile_replaced(vault: DataFrame, incoming: DataFrame, user: str = "user_id") -> DataFrame:
    """The vault with the profile rows of the users in incoming replaced by incoming; rows of documents and of other users stay."""
    users = incoming.select(user).distinct().withColumn("__new", F.lit(True))
    old = vault.join(users, user, "left").where(F.col("__new").isNull() | ~F.col("token").startswith("profile:")).select(*vault.columns)
    return old.unionByName(incoming.select(*vault.columns))


def newest_first(table: DataFrame, user: object, column: str = "created_at", then: str | None = None) -> DataFrame:
    return table.where(F.col("user_id") == user).orderBy(F.desc(column), *([F.desc(then)] if then else []))


def consented(events: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Events of users who have consented; those of others are dropped."""
    return events.join(users.where(F.col("consent_at").isNotNull()).select(F.col("id").alias(key)), key, "left_semi")


def patched(table: DataFrame, patches: DataFrame, key: str, now: Column | None = None, stamp: str | None = "updated_at") -> DataFrame:
    """table with patches applied. patches: key and `fields`, a map from column to new value as string.

    A column that a patch does not name stays; one it names with null becomes null. Changed rows get `stamp` if the table has it.
    """
    p = patches.select(F.col(key).alias("__key"), F.col("fields").alias("__fields"))
    joined = table.join(p, F.col(key) == F.col("__key"), "left")
    out = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == stamp and now is not None:
            c = F.when(F.col("__key").isNotNull(), now).otherwise(c)
        elif f.name != key:
            c = F.when(F.map_contains_key(F.col("__fields"), f.name), F.col("__fields")[f.name].cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return joined.select(*out)


def missing_keys(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches whose row does not exist: they are errors, not inserts."""
    return patches.join(table.select(key), key, "left_anti")


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows of those keys; keys that are not there do no harm."""
    return table.join(keys.select(key), key, "left_anti")


def upserted(table: DataFrame, incoming: DataFrame, keys: tuple[str, ...], defaults: Mapping[str, Column], order: str | None = None) -> DataFrame:
    """Rows of equal keys take what incoming has for columns it names (null keeps); new ones are inserted with defaults.

    Of repeated incoming keys the last by the column `order` counts, which is no column of the table itself; without one any of them does.
    """
    given = [c for c in incoming.columns if c not in keys and c != order]
    if order:
        incoming = incoming.groupBy(*keys).agg(F.max_by(F.struct(*given, F.lit(True).alias("__any")), order).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in given])
    new = incoming.dropDuplicates(list(keys)).select(*keys, *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__in"))
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, list(keys), "full_outer")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        updated = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in given else F.col(c)
        inserted = F.coalesce(F.col(f"__{c}"), defaults.get(c, F.lit(None))) if c in given else defaults.get(c, F.lit(None))
        out.append(F.when(F.col("__old"), updated).otherwise(inserted).alias(c))
    return both.select(*out)


def expired(now: Column, column: str = "delete_after") -> Column:
    """Past its time: strictly before now; without a time never."""
    return F.coalesce(F.col(column) < now, F.lit(False))


def purged(tables: Mapping[str, DataFrame], now: Column, include_watches: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without expired rows, counts as table_name, deleted_count in purge order)."""
    names = [*PURGE_ORDER, *(["watches"] if include_watches else [])]
    kept = {n: (t.where(~expired(now)) if n in names else t) for n, t in tables.items()}
    counts = None
    for place, n in enumerate(n for n in names if n in tables):
        one = tables[n].agg(F.count_if(expired(now)).alias("deleted_count")).select(F.lit(place).alias("place"), F.lit(n).alias("table_name"), "deleted_count")
        counts = one if counts is None else counts.unionAll(one)
    return kept, counts


def purge_total(counts: DataFrame) -> DataFrame:
    """total: how many rows went, of all tables."""
    return counts.agg(F.coalesce(F.sum("deleted_count"), F.lit(0)).alias("total"))


def cascaded(tables: Mapping[str, DataFrame], users: DataFrame, action: str | None = None, now: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without those users and all that hangs on them, counts as table_name, deleted_count). users: a column `id`.

    Doomed keys are followed from parents to children by semi-joins, along every foreign key that a table has; audit rows stay, their
    user_id becomes null. With an action the audit log gets a row for each user there was, which tells of it without naming the user.
    """
    doomed = {"users": users.select("id")}
    out, counts = dict(tables), []
    for child, column, parent in CASCADE:
        if child in tables and parent in doomed and column in tables[child].columns:
            hit = tables[child].join(doomed[parent].select(F.col("id").alias(column)), column, "left_semi").select("id")
            doomed[child] = doomed[child].union(hit) if child in doomed else hit
    for name in dict.fromkeys(("users", *(c for c, _, _ in CASCADE))):
        if name in tables and name in doomed:
            hit = tables[name].join(doomed[name], "id", "left_semi")
            counts.append(hit.agg(F.count(F.lit(1)).alias("deleted_count")).select(F.lit(name).alias("table_name"), "deleted_count"))
            out[name] = without(tables[name], doomed[name], "id")
    if "audit_log" in tables:
        gone = users.select(F.col("id").alias("__gone"))
        audit = tables["audit_log"]
        out["audit_log"] = audit.join(gone, F.col("user_id") == F.col("__gone"), "left").withColumn("user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))).drop("__gone")
        if action:
            told = tables["users"].join(doomed["users"].distinct(), "id", "left_semi").select(F.uuid().alias("id"), F.lit(action).alias("action"), (F.current_timestamp() if now is None else now).alias("created_at"))
            told = told.select(*[F.col(c).cast(audit.schema[c].dataType) for c in told.columns if c in audit.columns])
            out["audit_log"] = out["audit_log"].unionByName(told, allowMissingColumns=True)
    total = counts[0]
    for c in counts[1:]:
        total = total.unionAll(c)
    return out, total


def draft_gate(old_status: Column, old_approved_at: Column, new_status: Column) -> Column:
    """What a draft's change of state violates, null if nothing: no draft is born sent, and only an approved one with its time of approval is sent."""
    born = F.when(old_status.isNull() & (new_status == "sent"), "inserted as sent")
    return F.coalesce(born, F.when(old_status.isNotNull() & (new_status == "sent") & ~((old_status == "approved") & old_approved_at.isNotNull()), "sent without approval"))


def enum_violations(table: DataFrame, name: str) -> DataFrame:
    """Rows whose enumerated columns hold something else."""
    bad = F.lit(False)
    for (t, column), allowed in ENUMS.items():
        if t == name:
            bad = bad | F.coalesce(~F.col(column).isin(*allowed), F.lit(False))
    return table.where(bad)


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Key values that a unique constraint would refuse."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(table: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose foreign key names no row."""
    return table.where(F.col(column).isNotNull()).join(parents.select(F.col("id").alias(column)), column, "left_anti")
