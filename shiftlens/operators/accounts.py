"""Account lookups: API keys, refresh tokens and their families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_max, with_running


def active_keys(keys: DataFrame, user_id: str) -> DataFrame:
    return keys.filter((F.col("user_id") == user_id) & ~F.col("revoked")).orderBy(F.desc("created_at"), F.desc("id"))


def key_owner(presented: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """The user behind each presented key; revoked keys and disabled users have none."""
    live = keys.filter(~F.col("revoked")).select("key_hash", "user_id")
    people = users.filter(~F.col("disabled")).select(F.col("id").alias("user_id"), "login", "role")
    # resolved first, so that unknown keys do not meet on a NULL user
    return presented.join(live.join(people, "user_id"), "key_hash", "left").select("key_hash", "user_id", "login", "role")


def request_gate(requests: DataFrame, keys: DataFrame, claims: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Who is behind each request, and whether the request may pass.

    ``requests`` has (request_id, header, admin_only), ``keys`` (key_hash, user_id, revoked), ``claims`` the content of access
    tokens whose signature holds, one row per (token_hash, user_id, purpose, expires_at).  A token that begins with
    ``pk_`` is looked up as a key only, any other as an access token only.  A token of the sign-on exchange, an expired
    or revoked one, and a disabled or unknown user give 401, a user without the role 403 where the request asks for it.
    NULL headers carry no token.  The lookups are resolved to users before requests meet them, so every request
    meets at most one row, and a token that sends most of the requests is split by adaptive execution.
    """
    bearer = F.coalesce(F.col("header").startswith("Bearer "), F.lit(False))
    token = F.when(bearer, F.regexp_replace(F.substring("header", len("Bearer ") + 1, 2**31 - 1), r"^\s+|\s+$", "")).otherwise("")
    rows = requests.select("request_id", "admin_only", token.alias("token"))
    rows = rows.withColumn("token_hash", F.when(F.col("token") != "", F.sha2("token", 256))).withColumn("by_key", F.col("token").startswith("pk_"))
    sign_on = F.coalesce(F.col("purpose") == "oauth-state", F.lit(False))
    valid = keys.select(F.col("key_hash").alias("token_hash"), "user_id", F.lit(True).alias("by_key"), (~F.col("revoked")).alias("valid")).unionByName(
        claims.select("token_hash", "user_id", F.lit(False).alias("by_key"), (~sign_on & (F.col("expires_at") > now)).alias("valid"))
    )
    people = users.select(F.col("id").alias("user_id"), "role", "disabled", F.lit(True).alias("known"))
    known = valid.join(people, "user_id", "left").select("token_hash", "by_key", "user_id", "role", "valid", (F.coalesce("known", F.lit(False)) & ~F.coalesce("disabled", F.lit(False))).alias("may_act"))
    met = rows.join(known, ["token_hash", "by_key"], "left")
    reason = (
        F.when(F.col("token") == "", "no_token")
        .when(~F.coalesce("valid", F.lit(False)) | (F.col("by_key") & ~F.col("may_act")), F.when(F.col("by_key"), "bad_key").otherwise("bad_token"))
        .when(~F.col("may_act"), "bad_user")
        .when(F.col("admin_only") & ~F.coalesce(F.col("role") == "admin", F.lit(False)), "not_admin")
        .otherwise("passed")
    )
    status = F.when(F.col("reason") == "passed", 200).when(F.col("reason") == "not_admin", 403).otherwise(401)
    judged = met.withColumn("reason", reason).withColumn("status", status)
    return judged.select("request_id", F.when(F.col("status") != 401, F.col("user_id")).alias("user_id"), "status", "reason")


def token_outcome(known: Column, revoked: Column, expires_at: Column, now: Column, disabled: Column) -> Column:
    """What presenting a refresh token leads to; the first rule that applies wins."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown")
        .when(revoked, "reuse")
        .when(expires_at <= now, "expired")
        .when(F.coalesce(disabled, F.lit(True)), "no_user")
        .otherwise("rotated")
    )


def token_uses(uses: DataFrame) -> DataFrame:
    """Replay a log of token uses.

    ``uses`` has (family_id, seq, generation).  A use retires its generation and issues the next, so
    a use is a reuse when the same or a later generation was used before.  The first reuse revokes
    the family, and every later use of it is one too.  A running maximum suffices, hence no family
    has to fit one task.
    """
    seen = with_running(
        uses, ["family_id"], ["seq"], {"newest": running_max(F.col("generation"), inclusive=False)}
    )
    replay = F.coalesce(F.col("generation") <= F.col("newest"), F.lit(False))
    marked = seen.withColumn("replay", replay)
    first = marked.filter("replay").groupBy("family_id").agg(F.min("seq").alias("killed_at"))
    dead = F.coalesce(F.col("seq") >= F.col("killed_at"), F.lit(False))
    verdict = F.when(dead, "reuse").otherwise("rotated")
    return marked.join(first, "family_id", "left").select("family_id", "seq", "generation", verdict.alias("outcome"))
