"""User and key registry: flatten, build from key entries, apply a change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .ordering import total_before

TOKEN = "struct<key:string,label:string,created_at:timestamp,expires_at:timestamp,revoked:boolean>"
USERS = (
    "id string, name string, email string, group string, rate_limit int, created_at timestamp, "
    f"tokens array<{TOKEN}>"
)
CHANGES = (
    "seq bigint, ts timestamp, op string, user_id string, name string, email string, group string, "
    "rate_limit int, token_key string, label string, expires_in_hours int"
)
# Changes of one user are put in order in slices of this many sequence numbers.
_SEQ_CELL = 100_000
DEFAULT_GROUP, DEFAULT_LABEL, CONFIG_LABEL = "default", "api-key", "config"


def flatten_registry(users: DataFrame) -> DataFrame:
    """One row per user and token; users without tokens keep one row with null token columns."""
    return users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user"), "email", "group", "rate_limit",
        F.posexplode_outer("tokens").alias("position", "token"),
    ).select(
        "user_id", "user", "email", "group", "rate_limit", "position",
        F.col("token.key").alias("token_key"), F.col("token.label").alias("label"),
        F.col("token.created_at").alias("token_created_at"),
        F.col("token.expires_at").alias("expires_at"), F.col("token.revoked").alias("revoked"),
    )


def active_tokens(users: DataFrame) -> DataFrame:
    """The lookup table of live keys: revoked ones are out; a key given twice belongs to the later token."""
    live = flatten_registry(users).filter(F.col("token_key").isNotNull() & ~F.coalesce("revoked", F.lit(False)))
    newest = F.max(
        F.struct(
            "token_created_at", "user_id", "position", "user", "group", "rate_limit", "expires_at"
        )
    )
    return live.groupBy("token_key").agg(newest.alias("t")).select(
        "token_key", "t.user_id", "t.user", "t.group", "t.rate_limit", "t.expires_at"
    )


def registry_from_keys(entries: DataFrame, created_at: Column, order: str = "position") -> DataFrame:
    """Users from configured key entries (key, user, group, rate_limit); the last entry of a key wins."""
    last = F.max_by(F.struct("user", "group", "rate_limit"), order)
    kept = entries.groupBy("key").agg(last.alias("e")).select("key", "e.*")
    token = F.struct(
        F.col("key"), F.lit(CONFIG_LABEL).alias("label"), created_at.cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("revoked"),
    )
    return kept.select(
        F.substring(F.sha2("key", 256), 1, 16).alias("id"), F.col("user").alias("name"),
        F.lit(None).cast("string").alias("email"), "group",
        F.coalesce(F.col("rate_limit"), F.lit(0)).cast("int").alias("rate_limit"),
        created_at.cast("timestamp").alias("created_at"), F.array(token).alias("tokens"),
    )


def users(registry: DataFrame) -> DataFrame:
    """All users with the number of their live keys; raw keys stay out."""
    live = F.size(F.filter("tokens", lambda t: ~t["revoked"]))
    return registry.select("id", "name", "email", "group", "rate_limit", "created_at", live.alias("live_keys"))


def user_by_id(registry: DataFrame, user_id: str) -> DataFrame:
    """The user with this id; an unknown id raises an error when the frame is evaluated."""
    whole = F.struct(*[F.col(c) for c in registry.columns])
    found = registry.filter(F.col("id") == user_id).agg(F.first(whole).alias("u"))
    unknown = F.raise_error(F.lit(f"user not found: {user_id}")).cast("string")
    checked = found.withColumn("id", F.when(F.col("u").isNull(), unknown).otherwise(F.col("u.id")))
    return checked.select("id", *[F.col(f"u.{c}") for c in registry.columns if c != "id"])


def judge_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The change feed with defaults filled in and, for changes that cannot apply, the ``error``.

    ``era`` counts the times the user was created or deleted before a change: tokens of an earlier era
    are gone.
    """
    c = changes.select(
        "seq", "ts", "op", "user_id", "name", "email",
        F.coalesce(F.nullif("group", F.lit("")), F.lit(DEFAULT_GROUP)).alias("group"),
        F.coalesce("rate_limit", F.lit(0)).alias("rate_limit"), "token_key",
        F.coalesce(F.nullif("label", F.lit("")), F.lit(DEFAULT_LABEL)).alias("label"),
        F.when(
            F.col("expires_in_hours") > 0,
            F.col("ts") + F.make_dt_interval(F.lit(0), F.col("expires_in_hours")),
        ).alias("expires_at"),
    )
    known = registry.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    held = flatten_registry(registry).select("user_id", "token_key").filter("token_key is not null").distinct()
    c = c.join(known, "user_id", "left").join(
        held.withColumn("_held", F.lit(True)), ["user_id", "token_key"], "left"
    )
    resets_user = ((F.col("op") == "create_user") & (F.coalesce("name", F.lit("")) != "")) | (
        F.col("op") == "delete_user"
    )
    c = c.withColumn("_reset", resets_user.cast("int"))
    c = total_before(c, ["user_id"], ["seq"], F.expr(f"seq div {_SEQ_CELL}"), {"era": "_reset"})
    # What began an era says whether the user is there in it; before the first reset the registry does.
    began = c.filter("_reset = 1").select("user_id", (F.col("era") + 1).alias("era"), F.col("op").alias("_began"))
    c = c.join(began, ["user_id", "era"], "left").withColumn(
        "_exists", F.coalesce(F.col("_began") == "create_user", F.col("_known"), F.lit(False))
    )
    added = (
        c.filter((F.col("op") == "add_token") & F.col("_exists"))
        .groupBy("user_id", "token_key", "era")
        .agg(F.min("seq").alias("_added"))
    )
    c = c.join(added, ["user_id", "token_key", "era"], "left")
    has_token = F.coalesce(F.col("_added") < F.col("seq"), F.lit(False)) | (
        (F.col("era") == 0) & F.coalesce("_held", F.lit(False))
    )
    no_user = F.concat(F.lit("user not found: "), F.coalesce("user_id", F.lit("")))
    error = (
        F.when(F.col("op") == "create_user", F.when(F.col("_reset") == 0, F.lit("Name is required")))
        .when(F.coalesce("user_id", F.lit("")) == "", F.lit("user_id is required"))
        .when(~F.col("_exists"), no_user)
        .when((F.col("op") == "revoke_token") & ~has_token, F.lit("token not found"))
    )
    return c.withColumn("error", error).drop("_known", "_held", "_reset", "_exists", "_began", "_added")


def apply_registry_changes(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the registry after the changes in ``seq`` order, the rejected changes with their error)."""
    judged = cut_lineage(judge_changes(registry, changes), "judged-changes")
    applied = judged.filter("error is null")
    resets = applied.filter(F.col("op").isin("create_user", "delete_user")).groupBy("user_id").agg(
        F.max(
            F.struct("seq", "op", "name", "email", "group", "rate_limit", "ts")
        ).alias("r"),
        F.max("era").alias("last_era"),
    )
    resets = resets.select("user_id", (F.col("last_era") + 1).alias("era"), "r.*")
    kept = registry.join(resets.select(F.col("user_id").alias("id")), "id", "left_anti")
    created = resets.filter("op = 'create_user'").select(
        F.col("user_id").alias("id"), "name", "email", "group", "rate_limit",
        F.col("ts").alias("created_at"), "era",
    )
    people = kept.select(
        "id", "name", "email", "group", "rate_limit", "created_at", F.lit(0).cast("bigint").alias("era")
    ).unionByName(created)

    old = flatten_registry(kept).filter("token_key is not null").select(
        "user_id", F.lit(0).cast("bigint").alias("era"), F.lit(-1).cast("bigint").alias("seq"), "position",
        "token_key", "label", F.col("token_created_at").alias("created_at"), "expires_at", "revoked",
    )
    new = applied.filter("op = 'add_token'").select(
        "user_id", "era", "seq", F.lit(0).alias("position"), "token_key", "label",
        F.col("ts").alias("created_at"), "expires_at", F.lit(False).alias("revoked"),
    )
    revoked = applied.filter("op = 'revoke_token'").select(
        "user_id", "era", "token_key", F.lit(True).alias("_now")
    ).distinct()
    tokens = old.unionByName(new).join(revoked, ["user_id", "era", "token_key"], "left").withColumn(
        "revoked", F.col("revoked") | F.coalesce("_now", F.lit(False))
    )
    lists = tokens.groupBy(F.col("user_id").alias("id"), "era").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "seq", "position",
                    F.struct(F.col("token_key").alias("key"), "label", "created_at", "expires_at", "revoked")
                    .alias("token"),
                )
            )
        ).alias("_tokens")
    )
    after = people.join(lists, ["id", "era"], "left").select(
        "id", "name", "email", "group", "rate_limit", "created_at",
        F.coalesce(F.transform("_tokens", lambda t: t["token"]), F.array().cast(f"array<{TOKEN}>")).alias("tokens"),
    )
    return after, judged.filter("error is not null")


def token_history(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """(token_key, valid_from, valid_until, user_id, user, group, rate_limit, expires_at): whose key each was, and when.

    A key is granted by the registry (valid_from null: always) or by an applied change, and holds until it is revoked
    or its user is deleted or created again; valid_until is the first instant at which it is gone, null if it stays.
    The intervals of a key do not overlap: while it is granted twice it belongs to the later grant. The feed's times
    ascend with ``seq``. Work per key grows with the square of the grants of that one key.
    """
    applied = cut_lineage(judge_changes(registry, changes).filter("error is null"), "applied-changes")
    nothing = F.lit(None).cast("timestamp")
    old = flatten_registry(registry).filter(F.col("token_key").isNotNull() & ~F.coalesce("revoked", F.lit(False))).select(
        "user_id", F.lit(0).cast("bigint").alias("era"), "token_key", F.lit(-1).cast("bigint").alias("seq"), "position",
        nothing.alias("valid_from"), F.col("token_created_at").alias("created_at"), "expires_at",
    )
    new = applied.filter("op = 'add_token' and token_key is not null").select(
        "user_id", "era", "token_key", "seq", F.lit(0).alias("position"), F.col("ts").alias("valid_from"),
        F.col("ts").alias("created_at"), "expires_at",
    )
    revoked = applied.filter("op = 'revoke_token'").select("user_id", "era", "token_key", "seq", F.col("ts").alias("gone"))
    following = Window.partitionBy("user_id", "era", "token_key").orderBy("seq", F.col("gone").asc_nulls_first()).rowsBetween(
        1, Window.unboundedFollowing
    )
    grants = old.unionByName(new).withColumn("is_grant", F.lit(True)).unionByName(revoked, allowMissingColumns=True)
    grants = grants.withColumn("gone", F.first("gone", ignorenulls=True).over(following)).filter("is_grant").drop("is_grant")
    # A reset carries the number of the era that it ends; the next one is that of the user it makes, if any.
    resets = applied.filter(F.col("op").isin("create_user", "delete_user"))
    people = registry.select(F.col("id").alias("user_id"), F.lit(0).cast("bigint").alias("era"), F.col("name").alias("user"), "group", "rate_limit")
    made = resets.filter("op = 'create_user'").select("user_id", (F.col("era") + 1).alias("era"), F.col("name").alias("user"), "group", "rate_limit")
    ended = resets.select("user_id", "era", F.col("ts").alias("reset"))
    grants = grants.join(people.unionByName(made), ["user_id", "era"]).join(ended, ["user_id", "era"], "left")
    grants = grants.withColumn("valid_until", F.least("gone", "reset")).filter("valid_from is null or valid_until is null or valid_from < valid_until")
    grants = cut_lineage(grants.drop("gone", "reset"), "grants")

    starts = grants.select("token_key", F.col("valid_from").alias("start"))
    stops = grants.filter("valid_until is not null").select("token_key", F.col("valid_until").alias("start"))
    in_order = Window.partitionBy("token_key").orderBy(F.col("start").asc_nulls_first())
    cells = starts.union(stops).distinct().withColumn("stop", F.lead("start").over(in_order))
    g = grants.select(F.col("token_key").alias("granted"), *[c for c in grants.columns if c != "token_key"])
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("start"))) & (
        F.col("valid_until").isNull() | F.col("start").isNull() | (F.col("start") < F.col("valid_until"))
    )
    later = F.max(F.struct("created_at", "user_id", "seq", "position", "user", "group", "rate_limit", "expires_at"))
    held = cells.join(g, (F.col("token_key") == F.col("granted")) & holds).groupBy("token_key", "start", "stop").agg(later.alias("t"))
    return held.select(
        "token_key", F.col("start").alias("valid_from"), F.col("stop").alias("valid_until"), "t.user_id", "t.user", "t.group",
        "t.rate_limit", "t.expires_at",
    )


def token_preview(users: DataFrame) -> DataFrame:
    """Live keys, masked: the first eight characters, dots, the last four."""
    rows = flatten_registry(users).filter("token_key is not null and not coalesce(revoked, false)")
    masked = F.concat(F.substring("token_key", 1, 8), F.lit("..."), F.right("token_key", F.lit(4)))
    return rows.select("user_id", "user", "label", masked.alias("preview"), "expires_at")
