"""Validation rules as arrays of messages (empty: valid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarnwork.storage import stored


def _messages(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda m: m.isNotNull())


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def note_errors(title: Column, content: Column) -> Column:
    t, c = _trimmed(title), _trimmed(content)
    return _messages(
        (t == "", "title required"), ((t != "") & (F.length(t) < 3), "title too short"), (F.length(t) > 100, "title too long"),
        (c == "", "content required"), ((c != "") & (F.length(c) < 5), "content too short"),
    )


def user_errors(username: Column, email: Column, password: Column) -> Column:
    return _messages(
        (F.length(_trimmed(username)) < 3, "username too short"), (~_trimmed(email).contains("@"), "email invalid"),
        (F.length(F.coalesce(password, F.lit(""))) < 8, "password too short"),
    )


def profile_errors(name: Column, bio: Column, image_url: Column) -> Column:
    return _messages(
        (_trimmed(name) == "", "name required"), (F.length(_trimmed(name)) > 100, "name too long"), (_trimmed(bio) == "", "bio required"),
        (F.length(_trimmed(bio)) > 500, "bio too long"), (~F.coalesce(image_url, F.lit("")).rlike(r"^https?://[^\s/]+"), "url invalid"),
    )


def taken(requested: DataFrame, known: DataFrame, *columns: str, order: str | None = None) -> DataFrame:
    """``requested`` with ``errors`` for each column whose value a known row has already.

    With ``order`` (a column of distinct, non-NULL numbers) the requests are served in that order: a value
    is also taken if an earlier request that was granted has it. A request that was refused takes
    nothing. NULL is never taken.
    """
    if order is not None:
        return _served(requested, known, columns, order)
    out, errors = requested, []
    for c in columns:
        used = known.select(F.col(c).alias(f"__{c}")).distinct()
        out = out.join(used, F.col(c) == F.col(f"__{c}"), "left")
        errors.append(F.when(F.col(f"__{c}").isNotNull(), F.lit(f"{c} taken")))
    return out.withColumn("errors", F.filter(F.array(*errors), lambda m: m.isNotNull())).drop(*[f"__{c}" for c in columns])


def _served(requested: DataFrame, known: DataFrame, columns: tuple[str, ...], order: str) -> DataFrame:
    """Rounds over (request, value) rows: granted is who comes first for all its values, refused who follows a granted one.

    A round settles every request that waits for no other, so there are as many rounds as the
    longest chain of requests of which each waits for the one before.
    """
    pairs = [requested.select(F.col(order).alias("at"), F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    held = [known.select(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    claims = stored(union(pairs).filter("v IS NOT NULL"), "claims")
    used = stored(union(held).filter("v IS NOT NULL").distinct().withColumn("by", F.lit(None).cast("bigint")), "used")
    refused = claims.join(used, ["c", "v"], "left_semi").select("at").distinct()
    waiting = stored(claims.join(refused, "at", "left_anti"), "waiting")
    while waiting.limit(1).count():
        first = waiting.groupBy("c", "v").agg(F.min("at").alias("by"))
        ready = waiting.join(first, ["c", "v"]).groupBy("at").agg(F.bool_and(F.col("at") == F.col("by")).alias("ok")).filter("ok").select("at")
        granted = waiting.join(ready, "at", "left_semi").select("c", "v", F.col("at").cast("bigint").alias("by"))
        used = stored(used.unionByName(granted), "used")
        now = stored(waiting.join(used, ["c", "v"], "left_semi").select("at").distinct(), "settled")  # granted ones hold their own values
        waiting = stored(waiting.join(now, "at", "left_anti"), "waiting")
    lost = claims.join(used, ["c", "v"]).filter("by IS NULL OR by < at").groupBy("at").agg(F.collect_set("c").alias("lost"))
    joined = requested.join(lost.withColumnRenamed("at", "__at"), F.col(order) == F.col("__at"), "left")
    errors = F.array(*[F.when(F.array_contains("lost", c), F.lit(f"{c} taken")) for c in columns])
    return joined.withColumn("errors", F.filter(errors, lambda m: m.isNotNull())).drop("__at", "lost")


def constraint_violations(df: DataFrame, not_null=(), unique=(), references: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n): rows that break NOT NULL, keys that break UNIQUE, rows that refer to nothing (column -> table of one key column).

    All rules are judged in one scan: every row says what each rule has to know of it, and (rule,
    value) groups are counted together with the keys that references may have. NULL is a value for
    UNIQUE and refers to nothing that could be missing.
    """
    references = references or {}
    claim = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"))
    claims = [F.when(F.col(c).isNull(), claim(f"not null {c}", F.lit(""))) for c in not_null]
    claims += [claim(f"unique {c}", F.col(c)) for c in unique]
    claims += [F.when(F.col(c).isNotNull(), claim(f"foreign key {c}", F.col(c))) for c in references]
    rows = df.select(F.inline(F.filter(F.array(*claims), lambda x: x.isNotNull()))).withColumn("key", F.lit(0))
    for c, parents in references.items():
        rows = rows.unionByName(parents.select(F.lit(f"foreign key {c}").alias("rule"), F.col(parents.columns[0]).cast("string").alias("value"), F.lit(1).alias("key")))
    groups = rows.groupBy("rule", "value").agg(F.count_if(F.col("key") == 0).alias("n"), F.max("key").alias("key"))
    broken = F.when(F.col("rule").startswith("not null "), F.col("n")).when(F.col("rule").startswith("unique "), (F.col("n") > 1).cast("bigint")).otherwise(F.when(F.col("key") == 0, F.col("n")).otherwise(0))
    found = groups.groupBy("rule").agg(F.sum(broken).cast("bigint").alias("broken"))
    names = [*(f"not null {c}" for c in not_null), *(f"unique {c}" for c in unique), *(f"foreign key {c}" for c in references)]
    every = df.sparkSession.createDataFrame([(r,) for r in names], "rule string")
    return every.join(found, "rule", "left").select("rule", F.coalesce("broken", F.lit(0)).cast("bigint").alias("n"))
