"""Sealed values: AES-GCM bound to their owner, keyed fingerprints, profiles and key rotation."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.masking import PROFILE_FIELDS
from .tolerance import nfkc

KEY_VERSION = 1


def master_key(value: str | None, production: bool = True) -> bytes:
    """32 bytes from 64 hexadecimal digits. Without a value production refuses; elsewhere a fixed key is derived."""
    if value:
        if len(value) != 64:
            raise ValueError("the master key has 64 hexadecimal digits")
        return bytes.fromhex(value)
    if production:
        raise ValueError("a master key is needed in production")
    extracted = hmac.new(b"\0" * 32, b"development only", hashlib.sha256).digest()
    return hmac.new(extracted, b"vault\x01", hashlib.sha256).digest()


def scope(user: Column, document: Column, token: Column) -> Column:
    """What a sealed value is bound to; opening it under another owner fails."""
    return F.concat_ws(":", F.lit("vault:v1"), F.coalesce(user.cast("string"), F.lit("-")), F.coalesce(document.cast("string"), F.lit("-")), token)


def once(value: Column) -> Column:
    """value, worked out once for a row however often a plan uses it: Spark repeats nothing that depends on the task, and lets no filter on it sink."""
    return F.when(F.spark_partition_id() >= 0, value)


def seal(value: Column, key: bytes, bound: Column) -> Column:
    """struct(iv, ciphertext, auth_tag, key_version), in base64; a new random iv for each value, drawn where and when its row is made."""
    # for an empty iv Spark draws twelve bytes from the secure source; as it depends on the task, not even equal constants are sealed but once for two rows
    raw = F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), once(F.lit(b"")), bound.cast("binary"))
    part = lambda r, start, n: F.base64(F.substr(r, start if isinstance(start, Column) else F.lit(start), n if isinstance(n, Column) else F.lit(n)))
    cut = lambda r: F.struct(part(r, 1, 12).alias("iv"), part(r, 13, F.octet_length(r) - 28).alias("ciphertext"), part(r, F.octet_length(r) - 15, 16).alias("auth_tag"), F.lit(KEY_VERSION).alias("key_version"))
    return F.transform(F.array(once(raw)), cut)[0]  # the array names the sealed bytes


def opened(sealed: Column, key: bytes, bound: Column) -> Column:
    """The value, or null where it was tampered with or belongs to another scope."""
    raw = F.concat(F.unbase64(sealed["iv"]), F.unbase64(sealed["ciphertext"]), F.unbase64(sealed["auth_tag"]))
    return F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound.cast("binary")).cast("string")


def fingerprint(value: Column, key: bytes) -> Column:
    """The first 32 hexadecimal digits of HMAC-SHA256 over the value in lower case, compatibility forms folded; nothing of the value can be read off it."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.lower(nfkc(value)).cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32)


def sealed_matches(df: DataFrame, key: bytes, user: str = "user_id", document: str = "document_id", matches: str = "matches") -> DataFrame:
    """One vault row for each match of each document."""
    rows = df.select(F.col(user).alias("user_id"), F.col(document).alias("document_id"), F.explode(matches).alias("m"))
    rows = rows.select("user_id", "document_id", F.col("m.token").alias("token"), F.col("m.type").alias("entity_type"), F.col("m.original").alias("value"))
    bound = scope(F.col("user_id"), F.col("document_id"), F.col("token"))
    return rows.withColumn("sealed", seal(F.col("value"), key, bound)).select("user_id", "document_id", "token", "entity_type", "sealed.*")


def opened_vault(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault with `original`; rows that do not open are left out."""
    sealed = F.struct("iv", "ciphertext", "auth_tag")
    return vault.withColumn("original", once(opened(sealed, key, scope(F.col("user_id"), F.col("document_id"), F.col("token"))))).where(F.col("original").isNotNull())


def sealed_profiles(users: DataFrame, key: bytes, fields: Sequence[str], user: str = "user_id") -> DataFrame:
    """One vault row for each filled profile field, trimmed; blank ones are left out."""
    long = users.unpivot([user], list(fields), "field", "value").withColumn("value", F.trim("value")).where(F.col("value") != "")
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f, PROFILE_FIELDS[f])])
    rows = long.select(F.col(user).alias("user_id"), F.lit(None).cast("string").alias("document_id"), F.concat(F.lit("profile:"), F.col("field")).alias("token"), kinds[F.col("field")].alias("entity_type"), "value")
    bound = scope(F.col("user_id"), F.col("document_id"), F.col("token"))
    return rows.withColumn("sealed", seal(F.col("value"), key, bound)).select("user_id", "document_id", "token", "entity_type", "sealed.*")


def opened_profiles(vault: DataFrame, key: bytes, fields: Sequence[str]) -> DataFrame:
    """One row per user again, a column for each field."""
    rows = opened_vault(vault.where(F.col("token").startswith("profile:")), key)
    return rows.groupBy("user_id").pivot("token", [f"profile:{f}" for f in fields]).agg(F.first("original")).toDF("user_id", *fields)


def rotated(vault: DataFrame, old: bytes, new: bytes) -> tuple[DataFrame, DataFrame]:
    """(vault under the new key with key_version one higher, check): check has total, unreadable and unverified counts.

    The first is only to be written through rotated_checked, which looks at the counts.
    """
    bound = scope(F.col("user_id"), F.col("document_id"), F.col("token"))
    plain = vault.withColumn("__plain", once(opened(F.struct("iv", "ciphertext", "auth_tag"), old, bound)))
    again = plain.withColumn("__new", seal(F.col("__plain"), new, bound))
    check = again.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__plain").isNull()).alias("unreadable"),
        F.count_if(~opened(F.col("__new"), new, bound).eqNullSafe(F.col("__plain"))).alias("unverified"),
    )
    sealed = {"iv": F.col("__new.iv"), "ciphertext": F.col("__new.ciphertext"), "auth_tag": F.col("__new.auth_tag"), "key_version": F.col("key_version") + 1}
    out = again.select(*[sealed.get(c, F.col(c)).alias(c) for c in vault.columns])
    return out, check


def rotated_checked(vault: DataFrame, old: bytes, new: bytes, path: str, dry_run: bool = False) -> int:
    """Writes the vault under the new key to path, the oldest rows first where it has created_at, then by user, document and token, and returns its number of rows.

    A dry run writes nothing and returns how many rows there are, all of which open under the old key and again under the new one.
    A row that does not open under the old key stops it before anything is written; one that does not open again under the new key, as
    written, is an error as well, and the old vault is still what counts.
    """
    out, check = rotated(vault, old, new)
    before = check.first()
    if before["unreadable"]:
        raise ValueError(f"{before['unreadable']} of {before['total']} rows do not open; nothing was written")
    if before["unverified"]:
        raise ValueError(f"{before['unverified']} rows do not open under the new key; nothing was written")
    if dry_run:
        return before["total"]
    out.orderBy(*["created_at"] * ("created_at" in vault.columns), "user_id", "document_id", "token").write.parquet(path)
    made = out.sparkSession.read.parquet(path)
    keys = ["user_id", "document_id", "token"]
    side = lambda df, key, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], opened(F.struct("iv", "ciphertext", "auth_tag"), key, scope(*map(F.col, keys))).alias(name))
    same = [F.col(f"was_{k}").eqNullSafe(F.col(f"is_{k}")) for k in keys]
    lost = side(vault, old, "was").join(side(made, new, "is"), [*same, F.col("was").eqNullSafe(F.col("is")) & F.col("is").isNotNull()], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows do not open under the new key")
    return before["total"]
