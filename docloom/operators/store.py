"""Store-like queries on tables: messages, sessions, notifications, users, expiring keys.

Every list has a unique last sort key, times come as columns (never the clock), and soft-deleted rows are those with
``deleted_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def last_messages(messages: DataFrame, n: int = 50, session: str = "session_id", ts: str = "created_at", key: str = "id") -> DataFrame:
    """The last n messages of each session (all for n of 0), numbered in order of time (``seq``)."""
    newest = Window.partitionBy(session).orderBy(F.desc(ts), F.desc(key))
    kept = messages.withColumn("__n", F.row_number().over(newest))
    kept = kept.where(F.col("__n") <= n) if n > 0 else kept
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(ts, key))).drop("__n")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def delete_by(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def page(df: DataFrame, number: int = 1, size: int = 20, most: int = 100, *order: Column) -> DataFrame:
    """A page of a sorted list; sizes are held between 1 and ``most``."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(df: DataFrame, number: int, size: int, most: int, *order: Column) -> DataFrame:
    """A page with the number of rows of the whole list in ``total``; the count is one row joined to the page."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, number, size, most, *order).crossJoin(F.broadcast(total))


def soft_delete(df: DataFrame, ids: list, now: Column, key: str = "id") -> DataFrame:
    hit = F.col(key).isin(ids) & F.col("deleted_at").isNull()
    return df.withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at")))


def owned_by(sessions: DataFrame, user: Column | str) -> DataFrame:
    return live(sessions).where(F.col("user_id") == user)


def mark_read(notifications: DataFrame, recipient, key=None) -> DataFrame:
    """Notifications with those of a recipient (one of them, or all) read; ``modified`` tells which changed."""
    hit = (F.col("recipient_id") == recipient) & ~F.coalesce("is_read", F.lit(False))
    hit = hit if key is None else hit & (F.col("id") == key)
    return notifications.withColumn("modified", hit).withColumn("is_read", F.coalesce("is_read", F.lit(False)) | hit)


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("recipient_id").agg(F.count_if(~F.coalesce("is_read", F.lit(False))).alias("unread"))


def by_ids(users: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is in a list; ids that exist nowhere are dropped, order is not kept."""
    return users.join(ids.select(key).distinct(), key, "left_semi")


def search_users(users: DataFrame, pattern: str, name: str = "username") -> DataFrame:
    return users.where(F.col(name).rlike("(?i)" + pattern))


def is_banned(now: Column) -> Column:
    """Inactive, or banned until later than ``now``."""
    return ~F.coalesce("is_active", F.lit(True)) | F.coalesce(F.col("ban_until") > now, F.lit(False))


def auto_unban(users: DataFrame, now: Column) -> DataFrame:
    over = ~F.coalesce("is_active", F.lit(True)) & F.coalesce(F.col("ban_until") <= now, F.lit(False))
    return users.withColumns({"is_active": F.when(over, True).otherwise(F.col("is_active")), "ban_until": F.when(~over, F.col("ban_until"))})


def admin_list(users: DataFrame, status: str, now: Column) -> DataFrame:
    """Users by status: active, banned, deleted or all."""
    tests = {"active": F.col("deleted_at").isNull() & ~is_banned(now), "banned": F.col("deleted_at").isNull() & is_banned(now), "deleted": F.col("deleted_at").isNotNull(), "all": F.lit(True)}
    return users.where(tests[status])


def admin_action(users: DataFrame, target, action: str, now: Column, until: Column | None = None, reason: str | None = None) -> DataFrame:
    """Ban, unban, delete or restore a user who isn't an administrator; ``changed`` tells whether the row did."""
    hit = (F.col("id") == target) & (F.col("role") != "admin")
    change: dict[str, dict[str, Column]] = {
        "ban": {"is_active": F.lit(False), "ban_until": until if until is not None else F.lit(None).cast("timestamp"), "ban_reason": F.lit(reason)},
        "unban": {"is_active": F.lit(True), "ban_until": F.lit(None).cast("timestamp"), "ban_reason": F.lit(None).cast("string")},
        "delete": {"deleted_at": now},
        "restore": {"deleted_at": F.lit(None).cast("timestamp")},
    }
    out = users.withColumn("changed", hit)
    for name, value in change[action].items():
        out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return out


def user_stats(users: DataFrame, since: Column, now: Column) -> DataFrame:
    """One row of counts: total, active since, created since, banned, verified."""
    return users.agg(
        F.count("*").alias("total"), F.count_if(F.col("last_login") >= since).alias("active"), F.count_if(F.col("created_at") >= since).alias("created"), F.count_if(is_banned(now)).alias("banned"), F.count_if("is_verified").alias("verified")
    )


def otp_outcome(found: Column, verified: Column, stored: Column, given: Column, expires: Column, now: Column) -> Column:
    return (
        F.when(~found, "invalid").when(F.coalesce(verified, F.lit(False)), "already_verified").when(F.coalesce(stored != given, F.lit(True)), "invalid").when(expires < now, "expired").otherwise("ok")
    )


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin("user", "assistant"), F.lit(False))


def resend_outcome(found: Column, verified: Column) -> Column:
    return F.when(~found, "not_found").when(F.coalesce(verified, F.lit(False)), "already_verified").otherwise("sent")


def resend(rows: DataFrame, asked: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Verification rows (email, otp, otp_expires_at, is_verified) with new codes (email, otp) for those asked for that aren't verified yet."""
    joined = rows.join(asked.select("email", F.col("otp").alias("__otp")), "email", "left")
    hit = F.col("__otp").isNotNull() & ~F.coalesce("is_verified", F.lit(False))
    new = {"otp": F.col("__otp"), "otp_expires_at": now + F.expr(f"interval {minutes} minutes")}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def login_outcome(found: Column, provider: Column, password_ok: Column, verified: Column, active: Column) -> Column:
    return (
        F.when(~found, "not_found").when(provider != "local", "provider_mismatch").when(~password_ok, "bad_password").when(~verified, "unverified").when(~active, "inactive").otherwise("ok")
    )


def external_login_outcome(found: Column, provider: Column, given: Column, banned: Column) -> Column:
    return F.when(~found, "setup_required").when(provider != given, "provider_mismatch").when(banned, "banned").otherwise("ok")


def missing_collections(wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    return wanted.join(present, name, "left_anti")


def merge_settings(current: DataFrame, changes: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Settings with the fields of a change that aren't null."""
    new = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns])


def name_taken(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (id, username) with whether another user has the name."""
    held = users.select(F.col("id").alias("__id"), F.col("username").alias("__name"))
    taken = requests.join(held, (F.col("username") == F.col("__name")) & (F.col("id") != F.col("__id")), "left_semi").select("id").distinct().withColumn("taken", F.lit(True))
    return requests.join(taken, "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def upsert_verification(rows: DataFrame, users: DataFrame, new: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Verification rows (email, otp, otp_expires_at, is_verified) with new ones (email, otp) in place of old; users' addresses are refused."""
    ok = new.join(users.select("email"), "email", "left_anti")
    fresh = ok.select("email", "otp", (now + F.expr(f"interval {minutes} minutes")).alias("otp_expires_at"), F.lit(False).alias("is_verified"))
    return rows.join(fresh.select("email"), "email", "left_anti").unionByName(fresh)


def registration_outcome(requests: DataFrame, verifications: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (rid, email, username, nonce) with their outcome."""
    v = verifications.select(F.col("email").alias("v_email"), F.col("is_verified").alias("v_ok"), F.col("nonce").alias("v_nonce"))
    names, mails = users.select(F.col("username").alias("u_name")).distinct(), users.select(F.col("email").alias("u_mail")).distinct()
    joined = requests.join(v, requests.email == v.v_email, "left").join(names, requests.username == names.u_name, "left").join(mails, requests.email == mails.u_mail, "left")
    outcome = (
        F.when(F.col("v_email").isNull(), "no_verification").when(~F.col("v_ok"), "not_verified").when(~F.col("nonce").eqNullSafe(F.col("v_nonce")), "bad_nonce")
        .when(F.col("u_name").isNotNull(), "username_taken").when(F.col("u_mail").isNotNull(), "email_taken").otherwise("created")
    )
    return joined.select("rid", outcome.alias("outcome"))


def latest_keys(rows: DataFrame) -> DataFrame:
    """The last row of each key (key, value, set_at, ttl_seconds, seq); a null value is a tombstone."""
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "set_at", "ttl_seconds"), F.struct("set_at", "seq")).alias("r")).select("key", "r.*")


def live_keys(rows: DataFrame, now: Column) -> DataFrame:
    """Keys that are set and not expired, with the seconds they have left."""
    left = F.col("ttl_seconds") - (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("set_at").cast("timestamp")))
    return latest_keys(rows).withColumn("expires_in", left).where((F.col("expires_in") > 0) & F.col("value").isNotNull())


def sync_status(sources: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Each source with whether it is synced and for how long."""
    held = live_keys(rows, now).select(F.col("key").alias("source"), "expires_in")
    return sources.join(held, "source", "left").select("source", F.col("expires_in").isNotNull().alias("synced"), F.coalesce("expires_in", F.lit(0)).alias("expires_in"))


def sync_enabled(sources: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The status of those sources (source, enabled) that are enabled."""
    return sync_status(sources.where("enabled").select("source"), rows, now)


def invalidate(rows: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Key rows and a tombstone for each of ``keys`` (key), after which a lookup goes to the source again."""
    last = F.lit((1 << 63) - 1)
    return rows.unionByName(keys.select("key").distinct().select("key", F.lit(None).cast("string").alias("value"), now.alias("set_at"), F.lit(0).cast("long").alias("ttl_seconds"), last.alias("seq")))


def valid_tokens(tokens: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Tokens (jti, user_id) whose id isn't blacklisted and whose user isn't invalidated, by live keys ``jti:`` and ``user:``."""
    held = live_keys(rows, now).select("key")
    jti = held.where(F.startswith("key", F.lit("jti:"))).select(F.expr("substring(key, 5)").alias("jti"))
    users = held.where(F.startswith("key", F.lit("user:"))).select(F.expr("substring(key, 6)").alias("user_id"))
    return tokens.join(jti, "jti", "left_anti").join(users, "user_id", "left_anti")


def valid_claims(tokens: DataFrame, issuer: str, audience: str, now: Column) -> DataFrame:
    return tokens.where((F.col("iss") == issuer) & (F.col("aud") == audience) & (F.col("exp") > now))


def elapsed(seconds: Column) -> Column:
    """``Never``, ``Just now``, ``5m ago``, ``3h ago``, ``2d ago``."""
    ago = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "Never").when(seconds < 60, "Just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def increment(users: DataFrame, ids: DataFrame, column: str, by: int = 1, key: str = "id") -> DataFrame:
    """A counter raised for the listed users, once for each time that they are listed."""
    times = ids.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    joined = users.join(times, users[key] == times["__k"], "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("__n", F.lit(0)) * by).drop("__k", "__n")


def set_avatar(users: DataFrame, target, url: str | None, public_id: str | None, now: Column, key: str = "id") -> DataFrame:
    """A user's avatar set, or unset where there is no address."""
    new = F.struct(F.lit(url).alias("url"), F.lit(public_id).alias("public_id"), now.alias("uploaded_at")) if url else F.lit(None)
    return users.withColumn("avatar", F.when(F.col(key) == target, new).otherwise(F.col("avatar")))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def update_row(df: DataFrame, target, changes: dict[str, Column], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with one row's columns changed, and that row."""
    hit = F.col(key) == target
    out = df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
    return out, out.where(hit)


def name_exists(names: DataFrame, cache: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Whether names exist: by live cache rows (keys ``name:``), else by the users."""
    held = live_keys(cache, now).select(F.expr("substring(key, 6)").alias("username"), (F.col("value") == "true").alias("__cached"))
    known = users.select("username").distinct().withColumn("__known", F.lit(True))
    joined = names.join(held, "username", "left").join(known, "username", "left")
    return joined.select("username", F.coalesce("__cached", "__known", F.lit(False)).alias("taken"))


def message_metadata(sources: Column, tools: Column) -> Column:
    """What a chat message keeps of its sources and tool calls, as strings by name."""
    said = lambda a: F.to_json(a)
    return F.map_filter(F.map_from_arrays(F.array(F.lit("sources"), F.lit("tools")), F.array(said(sources), said(tools))), lambda _, v: v.isNotNull() & (v != "[]"))
