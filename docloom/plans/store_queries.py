"""Queries of the store operators: conversations stand for messages, customers for users, events for notifications and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import store
from docloom.plans.query import Query, read
from docloom.streaming import events as stream

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", "text")


def last_n_messages(spark: SparkSession, d: str) -> DataFrame:
    return store.last_messages(_messages(spark, d), 3).select("session_id", "id", "seq", "role", F.md5("text").alias("text_md5"))


LAST = """SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INT) AS seq, role, text_md5 FROM (SELECT conv_id AS session_id, turn AS id, role, md5(text) AS text_md5, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3"""


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.count_by(_messages(spark, d).where(F.col("role").isin("user", "assistant")), "session_id", "role")


COUNTS = "SELECT conv_id AS session_id, role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL"


def delete_by_session(spark: SparkSession, d: str) -> DataFrame:
    gone = _messages(spark, d).where("role = 'system'").select("session_id")
    return store.count_by(store.delete_by(_messages(spark, d), gone, "session_id"), "session_id")


DELETED = "SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1"


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    seen = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_login"), F.min("o_orderdate").alias("created_at"))
    c = read(spark, d, "customer").join(seen, k == F.col("o_custkey"), "left")
    return c.select(
        k.alias("id"), F.col("c_name").alias("username"), F.concat(F.lit("c"), k, F.lit("@x.org")).alias("email"), (k % 7 != 0).alias("is_active"), F.when(k % 5 == 0, F.lit("2024-02-01")).when(k % 5 == 1, F.lit("2023-01-01")).cast("timestamp_ntz").alias("ban_until"),
        F.when(k % 11 == 0, _now()).alias("deleted_at"), (k % 3 == 0).alias("is_verified"), "last_login", "created_at", F.when(k % 13 == 0, "admin").otherwise("user").alias("role"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").cast("string").alias("theme"),
    )


USERS = f"""users AS (SELECT c_custkey AS id, c_name AS username, 'c' || c_custkey || '@x.org' AS email, c_custkey % 7 <> 0 AS is_active, CASE c_custkey % 5 WHEN 0 THEN TIMESTAMP '2024-02-01' WHEN 1 THEN TIMESTAMP '2023-01-01' END AS ban_until,
CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '{NOW}' END AS deleted_at, c_custkey % 3 = 0 AS is_verified, last_login, created_at, CASE WHEN c_custkey % 13 = 0 THEN 'admin' ELSE 'user' END AS role, c_mktsegment AS language, CAST(c_nationkey AS VARCHAR) AS theme
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_login, min(o_orderdate) AS created_at FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""
BANNED = f"(NOT is_active OR coalesce(ban_until > TIMESTAMP '{NOW}', false))"


def session_page(spark: SparkSession, d: str) -> DataFrame:
    users = store.live(_users(spark, d))
    return store.page_with_total(users.select("id", "username", "created_at"), 2, 20, 100, F.col("created_at").desc_nulls_last(), F.col("id").asc())


PAGE = f"WITH {USERS} SELECT id, username, created_at, (SELECT count(*) FROM users WHERE deleted_at IS NULL) AS total FROM users WHERE deleted_at IS NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 20"


def user_search(spark: SparkSession, d: str) -> DataFrame:
    return store.search_users(store.live(_users(spark, d)), "CUSTOMER#0+[1-4]7").select("id", "username")


SEARCH = f"WITH {USERS} SELECT id, username FROM users WHERE deleted_at IS NULL AND regexp_matches(username, '(?i)CUSTOMER#0+[1-4]7')"


def users_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"))
    return store.by_ids(_users(spark, d), ids).select("id", "username", F.lit("").alias("email"))


BY_IDS = "SELECT c_custkey AS id, c_name AS username, '' AS email FROM customer WHERE c_custkey IN (SELECT s_suppkey * 20 FROM supplier)"


def admin_list(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    parts = [store.admin_list(users, s, _now()).select(F.lit(s).alias("status"), "id") for s in ("active", "banned", "deleted", "all")]
    return reduce(DataFrame.unionAll, parts).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


ADMIN = f"""WITH {USERS}, s AS (SELECT 'active' AS status, id FROM users WHERE deleted_at IS NULL AND NOT {BANNED} UNION ALL SELECT 'banned', id FROM users WHERE deleted_at IS NULL AND {BANNED} UNION ALL SELECT 'deleted', id FROM users WHERE deleted_at IS NOT NULL UNION ALL SELECT 'all', id FROM users)
SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM s GROUP BY 1"""


def user_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.user_stats(_users(spark, d), F.lit("2000-01-01").cast("timestamp_ntz"), _now())


STATS = f"""WITH {USERS} SELECT count(*) AS total, count(*) FILTER (last_login >= TIMESTAMP '2000-01-01') AS active, count(*) FILTER (created_at >= TIMESTAMP '2000-01-01') AS created, count(*) FILTER ({BANNED}) AS banned, count(*) FILTER (is_verified) AS verified FROM users"""


def auto_unban(spark: SparkSession, d: str) -> DataFrame:
    return store.auto_unban(_users(spark, d), _now()).select("id", "is_active", "ban_until", store.is_banned(_now()).alias("banned"))


UNBAN = f"""WITH {USERS}, u AS (SELECT id, CASE WHEN NOT is_active AND coalesce(ban_until <= TIMESTAMP '{NOW}', false) THEN true ELSE is_active END AS is_active, CASE WHEN NOT is_active AND coalesce(ban_until <= TIMESTAMP '{NOW}', false) THEN NULL ELSE ban_until END AS ban_until FROM users)
SELECT id, is_active, ban_until, {BANNED} AS banned FROM u"""


def admin_ban(spark: SparkSession, d: str) -> DataFrame:
    done = store.admin_action(_users(spark, d).withColumn("ban_reason", F.lit(None).cast("string")), 14, "ban", _now(), _now(), "spam")
    return done.select("id", "is_active", "ban_reason", "changed")


BAN = f"WITH {USERS} SELECT id, CASE WHEN id = 14 AND role <> 'admin' THEN false ELSE is_active END AS is_active, CASE WHEN id = 14 AND role <> 'admin' THEN 'spam' END AS ban_reason, id = 14 AND role <> 'admin' AS changed FROM users"


def login_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    out = store.login_outcome(k % 17 != 0, F.when(k % 4 == 0, "google").otherwise("local"), k % 6 != 1, F.col("is_verified"), F.col("is_active"))
    other = store.external_login_outcome(k % 17 != 0, F.when(k % 4 == 0, "google").otherwise("local"), F.lit("google"), store.is_banned(_now()))
    otp = store.otp_outcome(k % 17 != 0, F.col("is_verified"), (k % 9).cast("string"), (k % 2).cast("string"), F.coalesce("ban_until", F.lit("2030-01-01").cast("timestamp_ntz")), _now())
    return _users(spark, d).select("id", out.alias("login"), other.alias("external"), otp.alias("otp"))


LOGIN = f"""WITH {USERS} SELECT id, CASE WHEN id % 17 = 0 THEN 'not_found' WHEN id % 4 = 0 THEN 'provider_mismatch' WHEN id % 6 = 1 THEN 'bad_password' WHEN NOT is_verified THEN 'unverified' WHEN NOT is_active THEN 'inactive' ELSE 'ok' END AS login,
CASE WHEN id % 17 = 0 THEN 'setup_required' WHEN id % 4 <> 0 THEN 'provider_mismatch' WHEN {BANNED} THEN 'banned' ELSE 'ok' END AS external,
CASE WHEN id % 17 = 0 THEN 'invalid' WHEN is_verified THEN 'already_verified' WHEN id % 9 <> id % 2 THEN 'invalid' WHEN ban_until < TIMESTAMP '{NOW}' THEN 'expired' ELSE 'ok' END AS otp FROM users"""


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    changes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "vi").alias("language"), F.when(F.col("s_suppkey") % 3 == 0, "dark").alias("theme"))
    return store.merge_settings(_users(spark, d).select("id", "language", "theme"), changes, ["language", "theme"])


SETTINGS = f"WITH {USERS} SELECT id, CASE WHEN s_suppkey % 2 = 0 THEN 'vi' ELSE language END AS language, CASE WHEN s_suppkey % 3 = 0 THEN 'dark' ELSE theme END AS theme FROM users LEFT JOIN supplier ON s_suppkey = id"


def registration_outcome(spark: SparkSession, d: str) -> DataFrame:
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    mail = F.concat(F.lit("c"), F.col("c_custkey"))
    asked = c.select(F.col("c_custkey").alias("rid"), mail.alias("email"), F.concat(F.lit("u"), F.col("c_custkey") % 997).alias("username"), F.col("c_nationkey").alias("nonce"))
    held = c.where("c_acctbal > 0").select(mail.alias("email"), (F.col("c_nationkey") < 20).alias("is_verified"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nonce"))
    users = s.select(F.concat(F.lit("u"), F.col("s_suppkey")).alias("username"), F.concat(F.lit("c"), F.col("s_suppkey") * 10 + 1).alias("email"))
    return store.registration_outcome(asked, held, users)


REGISTER = """SELECT c_custkey AS rid, CASE WHEN c_acctbal <= 0 THEN 'no_verification' WHEN c_nationkey >= 20 THEN 'not_verified' WHEN c_custkey % 5 = 0 THEN 'bad_nonce' WHEN c_custkey % 997 IN (SELECT s_suppkey FROM supplier) THEN 'username_taken'
WHEN c_custkey IN (SELECT s_suppkey * 10 + 1 FROM supplier) THEN 'email_taken' ELSE 'created' END AS outcome FROM customer"""


def verification_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    mail = F.concat(F.lit("m"), F.col("c_custkey") % 1000)
    held = c.where("c_custkey < 1000").select(mail.alias("email"), F.lit("old").alias("otp"), F.lit("2024-01-01").cast("timestamp_ntz").alias("otp_expires_at"), F.lit(True).alias("is_verified"))
    new = c.where("c_custkey >= 1000").select(mail.alias("email"), F.lit("new").alias("otp"))
    users = read(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("email"))
    return store.upsert_verification(held, users, new, _now()).groupBy("otp", "is_verified", "otp_expires_at").agg(F.count("*").alias("n"))


UPSERT = f"""WITH h AS (SELECT 'm' || c_custkey AS email FROM customer WHERE c_custkey < 1000), n AS (SELECT 'm' || (c_custkey % 1000) AS email FROM customer WHERE c_custkey >= 1000 AND 'm' || (c_custkey % 1000) NOT IN (SELECT 'm' || s_suppkey FROM supplier))
SELECT 'old' AS otp, true AS is_verified, TIMESTAMP '2024-01-01' AS otp_expires_at, count(*) AS n FROM h WHERE email NOT IN (SELECT email FROM n) HAVING count(*) > 0 UNION ALL SELECT 'new', false, TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE, count(*) FROM n HAVING count(*) > 0"""


def username_taken(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d).select("id", "username")
    asked = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.format_string("Customer#%09d", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1)).alias("username"))
    return store.name_taken(asked, users).select("id", "taken")


TAKEN = "SELECT s_suppkey AS id, s_suppkey % 2 <> 0 AND s_suppkey + 1 IN (SELECT c_custkey FROM customer) AS taken FROM supplier"


def _notifications(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("recipient_id"), F.col("event_type").alias("type"), F.when(F.col("value") < 30, True).alias("is_read"), F.col("ts").alias("created_at"))


def notification_page(spark: SparkSession, d: str) -> DataFrame:
    own = _notifications(spark, d).where("recipient_id = 7").select("id", "type", "created_at")
    return store.page_with_total(own, 2, 15, 100, F.col("created_at").desc(), F.col("id").desc())


NOTES = "SELECT event_id AS id, event_type AS type, ts AS created_at, count(*) OVER () AS total FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 15 OFFSET 15"


def unread_count(spark: SparkSession, d: str) -> DataFrame:
    return store.unread_counts(_notifications(spark, d))


UNREAD = "SELECT user_id AS recipient_id, count(*) FILTER (value >= 30) AS unread FROM events GROUP BY 1"


def mark_all_read(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_read(_notifications(spark, d), 7).groupBy("recipient_id").agg(F.count_if("modified").alias("modified"), F.count_if("is_read").alias("read"))


MARK = "SELECT user_id AS recipient_id, count(*) FILTER (user_id = 7 AND value >= 30) AS modified, count(*) FILTER (user_id = 7 OR value < 30) AS read FROM events GROUP BY 1"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "jti:").when(F.col("event_type") == "click", "user:").otherwise("src:")
    return read(spark, d, "events").select(
        F.concat(kind, F.col("user_id")).alias("key"), F.when(F.col("value") > 3, F.col("props")).alias("value"), F.col("ts").alias("set_at"), (F.floor(F.col("value")) * 7200).cast("long").alias("ttl_seconds"), F.col("event_id").alias("seq")
    )


KEYS = f"""kv AS (SELECT CASE event_type WHEN 'view' THEN 'jti:' WHEN 'click' THEN 'user:' ELSE 'src:' END || user_id AS key, CASE WHEN value > 3 THEN props END AS value, ts AS set_at, CAST(floor(value) * 7200 AS BIGINT) AS ttl, event_id AS seq FROM events),
live AS (SELECT key, value, set_at, ttl, ttl - (epoch(date_trunc('second', TIMESTAMP '{NOW}')) - CAST(floor(epoch(set_at)) AS BIGINT)) AS expires_in FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY set_at DESC, seq DESC) AS n FROM kv) WHERE n = 1),
held AS (SELECT key, CAST(expires_in AS BIGINT) AS expires_in FROM live WHERE expires_in > 0 AND value IS NOT NULL)"""


def ttl_status(spark: SparkSession, d: str) -> DataFrame:
    names = _keys(spark, d).select(F.col("key").alias("source")).distinct()
    return store.sync_status(names, _keys(spark, d), _now())


TTL = f"WITH {KEYS} SELECT DISTINCT kv.key AS source, held.key IS NOT NULL AS synced, coalesce(expires_in, 0) AS expires_in FROM kv LEFT JOIN held USING (key)"


def token_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tokens = read(spark, d, "customer").select(k.cast("string").alias("jti"), (k % 150).cast("string").alias("user_id"), F.when(k % 10 == 0, "x").otherwise("us").alias("iss"), F.lit("web").alias("aud"), F.when(k % 9 == 0, F.lit("2023-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp_ntz").alias("exp"))
    good = store.valid_claims(store.valid_tokens(tokens, _keys(spark, d), _now()), "us", "web", _now())
    return good.select("jti", "user_id")


TOKENS = f"""WITH {KEYS} SELECT CAST(c_custkey AS VARCHAR) AS jti, CAST(c_custkey % 150 AS VARCHAR) AS user_id FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 9 <> 0 AND 'jti:' || c_custkey NOT IN (SELECT key FROM held) AND 'user:' || (c_custkey % 150) NOT IN (SELECT key FROM held)"""


def elapsed_bucket(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_seconds(_now().cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 3 == 0, 1_000_000).otherwise(0)
    return read(spark, d, "events").select("event_id", store.elapsed(F.when(F.col("event_id") % 5 != 0, F.greatest(seconds, F.lit(0)))).alias("ago"))


ELAPSED = f"""SELECT event_id, CASE WHEN s IS NULL THEN 'Never' WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago
FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN greatest(0, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 3 = 0 THEN 1000000 ELSE 0 END) END AS s FROM events)"""


def thread_state(spark: SparkSession, d: str) -> DataFrame:
    threads = stream.thread_state(read(spark, d, "conversations").withColumnRenamed("conv_id", "thread_id"))
    return threads.select("thread_id", "n", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")).alias("messages_md5"))


THREADS = "SELECT conv_id AS thread_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1"


def route_notifications(spark: SparkSession, d: str) -> DataFrame:
    clients = read(spark, d, "orders").select((F.col("o_custkey") % 120).alias("user_id"), F.col("o_orderkey").alias("client_id"), F.col("o_orderdate").alias("connected_at"))
    return stream.route(_notifications(spark, d), clients).groupBy("recipient_id", "client_id").agg(F.count("*").alias("n"))


ROUTE = "SELECT user_id AS recipient_id, client_id, count(*) AS n FROM events JOIN (SELECT o_custkey % 120 AS u, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS client_id FROM orders GROUP BY 1) ON u = user_id GROUP BY ALL"


def broadcast_notifications(spark: SparkSession, d: str) -> DataFrame:
    clients = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("client_id"), F.col("c_acctbal").alias("connected_at"))
    sent = read(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.col("user_id"), F.col("user_id") + 1, F.lit(-5).cast("long")).alias("recipient_ids"))
    return stream.broadcast_to(sent, clients).groupBy("recipient_id").agg(F.count("*").alias("n"))


BROADCAST = "SELECT r AS recipient_id, count(*) AS n FROM (SELECT unnest([user_id, user_id + 1, -5]) AS r FROM events) WHERE r IN (SELECT c_custkey FROM customer) GROUP BY 1"


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("topic"))
    counted = stream.windowed_counts(rows)
    return counted.select(F.unix_seconds("start").alias("start"), "topic", "n")


HOURLY = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS topic, count(*) AS n FROM events GROUP BY ALL"


def subscribe_topic(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("props").alias("payload"), F.col("event_id").alias("ts"))
    return stream.subscribe(rows, "click", "k int").select(F.col("ts").alias("event_id"), "k")


SUBSCRIBE = "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'click'"

def user_updates(spark: SparkSession, d: str) -> DataFrame:
    """Counters raised by orders, and whose address is one."""
    users = _users(spark, d).withColumn("reputation", F.when(F.col("id") % 2 == 0, F.col("id")))
    raised = store.increment(users, read(spark, d, "orders").select(F.col("o_custkey").alias("id")), "reputation", 2)
    return raised.select("id", "reputation", store.is_email(F.concat(F.col("email"), F.when(F.col("id") % 4 == 0, "!").otherwise(""))).alias("mail_ok"))


UPDATES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END + 2 * coalesce(n, 0) AS reputation, c_custkey % 4 <> 0 AS mail_ok FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def cached_names(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    name = F.format_string("Customer#%09d", F.col("user_id"))
    cache = e.select(F.concat(F.lit("name:"), name).alias("key"), F.when(F.col("value") > 50, "true").otherwise("false").alias("value"), F.col("ts").alias("set_at"), F.lit(86400 * 2).cast("long").alias("ttl_seconds"), F.col("event_id").alias("seq"))
    asked = e.select(name.alias("username")).distinct().unionAll(spark.createDataFrame([("nobody",)], "username string"))
    return store.name_exists(asked, cache, store.live(_users(spark, d)), _now())


CACHED = f"""WITH {USERS}, e AS (SELECT printf('Customer#%09d', user_id) AS username, user_id, value > 50 AS v, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT username, CASE WHEN 172800 - (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) > 0 THEN v ELSE user_id IN (SELECT id FROM users WHERE deleted_at IS NULL) END AS taken FROM e WHERE n = 1 UNION ALL SELECT 'nobody', false"""


def key_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """The keys of suppliers' numbers dropped from the cache: status of the enabled sources afterwards."""
    keys = _keys(spark, d)
    gone = read(spark, d, "supplier").select(F.concat(F.lit("src:"), F.col("s_suppkey")).alias("key"))
    sources = keys.select(F.col("key").alias("source")).distinct().withColumn("enabled", ~F.startswith("source", F.lit("jti:")))
    return store.sync_enabled(sources, store.invalidate(keys, gone, _now()), _now())


INVALID = f"""WITH {KEYS} SELECT DISTINCT kv.key AS source, held.key IS NOT NULL AS synced, coalesce(expires_in, 0) AS expires_in FROM kv LEFT JOIN (SELECT * FROM held WHERE key NOT IN (SELECT 'src:' || s_suppkey FROM supplier)) held USING (key) WHERE NOT starts_with(kv.key, 'jti:')"""


def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tokens = read(spark, d, "customer").select(k.alias("id"), F.when(F.col("c_acctbal") < 0, "x").otherwise("us").alias("iss"), F.col("c_mktsegment").alias("aud"), F.when(F.col("c_nationkey") < 8, F.lit(NOW)).otherwise(F.lit("2025-01-01")).cast("timestamp_ntz").alias("exp"))
    return store.valid_claims(tokens, "us", "BUILDING", _now()).select("id")


CLAIMS = "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING' AND c_nationkey >= 8"


def owned_sessions(spark: SparkSession, d: str) -> DataFrame:
    sessions = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_totalprice") < 100000, _now()).alias("deleted_at"))
    return store.owned_by(sessions, 7).select("id")


OWNED = "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_totalprice >= 100000"


def missing_collections(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "supplier").where("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("name"))
    return store.missing_collections(read(spark, d, "nation").select(F.col("n_nationkey").alias("name")), held)


MISSING = "SELECT n_nationkey AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 <> 0)"


def message_roles(spark: SparkSession, d: str) -> DataFrame:
    return store.count_by(_messages(spark, d).withColumn("valid", store.valid_role(F.col("role"))), "role", "valid")


ROLES = "SELECT role, role IN ('user', 'assistant') AS valid, count(*) AS n FROM conversations GROUP BY ALL"


def verification_resend(spark: SparkSession, d: str) -> DataFrame:
    mail = lambda k: F.concat(F.lit("m"), F.col(k))
    rows = read(spark, d, "customer").select(mail("c_custkey").alias("email"), F.lit("old").alias("otp"), F.lit("2024-01-01").cast("timestamp_ntz").alias("otp_expires_at"), (F.col("c_acctbal") > 0).alias("is_verified"))
    asked = read(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("k")).select(mail("k").alias("email"), F.lit("new").alias("otp"))
    outcome = asked.select("email").join(rows.select("email", "is_verified"), "email", "left").select("email", store.resend_outcome(F.col("is_verified").isNotNull(), F.col("is_verified")).alias("outcome"))
    return store.resend(rows, asked, _now()).join(outcome, "email", "full").select("email", "otp", "otp_expires_at", "outcome")


RESEND = f"""WITH a AS (SELECT s_suppkey * 20 AS k FROM supplier)
SELECT 'm' || coalesce(c_custkey, k) AS email, CASE WHEN c_custkey IS NULL THEN NULL WHEN k IS NOT NULL AND c_acctbal <= 0 THEN 'new' ELSE 'old' END AS otp,
CASE WHEN c_custkey IS NULL THEN NULL WHEN k IS NOT NULL AND c_acctbal <= 0 THEN TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE ELSE TIMESTAMP '2024-01-01' END AS otp_expires_at,
CASE WHEN k IS NULL THEN NULL WHEN c_custkey IS NULL THEN 'not_found' WHEN c_acctbal > 0 THEN 'already_verified' ELSE 'sent' END AS outcome FROM customer FULL JOIN a ON k = c_custkey"""


QUERIES = {
    "user_updates": Query(user_updates, UPDATES),
    "cached_names": Query(cached_names, CACHED),
    "key_invalidate": Query(key_invalidate, INVALID),
    "claim_checks": Query(claim_checks, CLAIMS),
    "owned_sessions": Query(owned_sessions, OWNED),
    "missing_collections": Query(missing_collections, MISSING),
    "message_roles": Query(message_roles, ROLES),
    "verification_resend": Query(verification_resend, RESEND),
    "last_n_messages": Query(last_n_messages, LAST),
    "session_counts": Query(session_counts, COUNTS),
    "delete_by_session": Query(delete_by_session, DELETED),
    "session_page": Query(session_page, PAGE),
    "user_search": Query(user_search, SEARCH),
    "users_by_ids": Query(users_by_ids, BY_IDS),
    "admin_list": Query(admin_list, ADMIN),
    "user_stats": Query(user_stats, STATS),
    "auto_unban": Query(auto_unban, UNBAN),
    "admin_ban": Query(admin_ban, BAN),
    "login_outcomes": Query(login_outcomes, LOGIN),
    "settings_merge": Query(settings_merge, SETTINGS),
    "registration_outcome": Query(registration_outcome, REGISTER),
    "verification_upsert": Query(verification_upsert, UPSERT),
    "username_taken": Query(username_taken, TAKEN),
    "notification_page": Query(notification_page, NOTES),
    "unread_count": Query(unread_count, UNREAD),
    "mark_all_read": Query(mark_all_read, MARK),
    "ttl_status": Query(ttl_status, TTL),
    "token_validity": Query(token_validity, TOKENS),
    "elapsed_bucket": Query(elapsed_bucket, ELAPSED),
    "thread_state": Query(thread_state, THREADS),
    "route_notifications": Query(route_notifications, ROUTE),
    "broadcast_notifications": Query(broadcast_notifications, BROADCAST),
    "hourly_events": Query(hourly_events, HOURLY),
    "subscribe_topic": Query(subscribe_topic, SUBSCRIBE),
}
