"""Normalisation of raw records to messages, discovery by rules, and sampling that doesn't depend on the rows' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, focus_text, revision_id, stable_rank

#: Fixed value: the channel of messages that a rule selects.
CHANNEL = "topic_rule"


def _kind(v: Column, path: str) -> Column:
    """The JSON type of a field: BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, ...; null if the field is missing or null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, key: str) -> Column:
    return F.when(_kind(v, f"$.{key}") == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def normalize(envelopes: DataFrame) -> DataFrame:
    """Messages of (source_id, source_kind, line_number, raw_line), with norm_error: what is wrong first, or null.

    Wrong records keep their row, so that both sides of the split can be counted; `valid` and `rejected` take them apart.
    A boolean is no number, a time must be a whole number of seconds, and nothing is made up for a missing field.
    """
    e = envelopes.withColumn("__v", F.try_parse_json("raw_line"))
    v = F.col("__v")
    submission = F.col("source_kind") == "submission"
    prefix = F.when(submission, "t3_").otherwise("t1_")
    missing = lambda k: F.coalesce(_kind(v, f"$.{k}"), F.lit("VOID")) == "VOID"
    named = F.when(missing("name"), F.concat(prefix, _text(v, "id"))).otherwise(_text(v, "name"))
    full = lambda c, p: c.startswith(p) & (F.length(c) > F.length(p))
    link, parent = _text(v, "link_id"), _text(v, "parent_id")
    number = lambda k: _kind(v, f"$.{k}").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    time = F.try_variant_get(v, "$.created_utc", "double")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(no(F.schema_of_variant(v).startswith("OBJECT")), "not an object")
        .when(no(full(named, prefix)), F.concat(F.lit("name: no full name with "), prefix))
        .when(~submission & no(full(link, F.lit("t3_"))), "link_id: no full name with t3_")
        .when(~missing("parent_id") & no(parent.startswith("t1_") | parent.startswith("t3_")), "parent_id: no full name with t1_ or t3_")
        .when(submission & _text(v, "title").isNull(), "title: no text")
        .when(submission & ~missing("selftext") & _text(v, "selftext").isNull(), "selftext: neither text nor null")
        .when(~submission & _text(v, "body").isNull(), "body: no text")
        .when(_text(v, "subreddit").isNull(), "subreddit: no text")
        .when(_text(v, "permalink").isNull(), "permalink: no text")
        .when(no(number("created_utc")) | no(time == F.floor(time)), "created_utc: no whole number of seconds")
        .when(~missing("score") & no(number("score")), "score: no number")
        .when(~missing("depth") & no(_kind(v, "$.depth") == "BIGINT"), "depth: no whole number")
    )
    title = F.when(submission, _text(v, "title")).otherwise("")
    body = F.when(submission, F.coalesce(_text(v, "selftext"), F.lit(""))).otherwise(_text(v, "body"))
    return e.select(
        named.alias("fullname"), F.col("source_kind").alias("kind"), F.when(submission, named).otherwise(link).alias("thread_fullname"), parent.alias("parent_fullname"),
        title.alias("raw_title"), body.alias("raw_body"), _text(v, "subreddit").alias("subreddit"), F.when(number("created_utc") & (time == F.floor(time)), time.cast("bigint")).alias("created_utc"), revision_id(title, body).alias("source_revision_id"),
        _text(v, "permalink").alias("permalink"), F.array(F.struct("source_id", "line_number")).alias("provenance"),
        F.when(number("score"), F.try_variant_get(v, "$.score", "double")).alias("archive_score"), F.when(_kind(v, "$.depth") == "BIGINT", F.try_variant_get(v, "$.depth", "bigint")).alias("depth"),
        F.array().cast("array<string>").alias("selection_channels"), F.array().cast("array<string>").alias("matched_rule_ids"), error.alias("norm_error"),
    )


def valid(normalized: DataFrame) -> DataFrame:
    return normalized.where("norm_error IS NULL").drop("norm_error")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where("norm_error IS NOT NULL").select("provenance", "norm_error")


def with_focus_text(messages: DataFrame) -> DataFrame:
    return messages.withColumn("focus_text", focus_text(F.col("raw_title"), F.col("raw_body")))


def matched_rules(text: Column, rules: dict[str, list[list[str]]]) -> Column:
    """Ids of the rules, in their order, of which every group has a term in the text. The text must be folded already; it is worked out once."""

    def holds(text: Column, groups: list[list[str]]) -> Column:
        every = F.lit(bool(groups))
        for group in groups:
            some = F.lit(False)
            for term in group:
                some = some | text.contains(term.casefold())
            every = every & some
        return every

    if not rules:
        return F.array().cast("array<string>")
    found = F.transform(F.array(text), lambda t: F.array_compact(F.array(*[F.when(holds(t, groups), F.lit(rule)) for rule, groups in rules.items()])))
    return found[0]


def discover(messages: DataFrame, rules: dict[str, list[list[str]]], text: Column | None = None) -> DataFrame:
    """Messages that any rule matches, with the rules' ids and the channel. Terms and texts are case-folded. Scores and depth play no part."""
    folded = casefold(F.concat_ws("\n", "raw_title", "raw_body")) if text is None else text
    found = messages.withColumn("matched_rule_ids", matched_rules(folded, rules)).where(F.size("matched_rule_ids") > 0)
    return found.withColumn("selection_channels", F.array(F.lit(CHANNEL)))


def one_per_name(messages: DataFrame, order: list[Column], name: str = "fullname", last: bool = False) -> DataFrame:
    """The first (or last) row of each name in the given order."""
    keys = [c.desc() for c in order] if last else order
    w = Window.partitionBy(name).orderBy(*keys)
    return messages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_by_hash(messages: DataFrame, target: int, seed: int, name: str = "fullname") -> DataFrame:
    """The `target` rows of least seeded digest, ties by name; a bounded heap in each task and one merge."""
    if target < 0:
        raise ValueError("target must not be negative")
    return messages.withColumn("__rank", stable_rank(seed, F.col(name))).orderBy("__rank", name).limit(target).drop("__rank")


def control_sample(messages: DataFrame, target: int, seed: int, order: list[Column]) -> DataFrame:
    """A sample in which the last row of a name counts."""
    return top_by_hash(one_per_name(messages, order, last=True), target, seed)


def thread_freeze(selected: DataFrame) -> DataFrame:
    """How many messages and different threads were selected."""
    return selected.agg(F.count("*").alias("selected"), F.countDistinct("thread_fullname").alias("threads"))


def thread_cap(rows: DataFrame, most: int | None = None, order: str = "rank", thread: str = "thread_fullname") -> DataFrame:
    """The first `most` rows of each thread in an order; all rows where no limit is set."""
    if most is None:
        return rows
    if most <= 0:
        raise ValueError("the limit must be positive")
    place = F.row_number().over(Window.partitionBy(thread).orderBy(order))
    return rows.withColumn("__place", place).where((F.col("__place") <= most) | F.col(thread).isNull()).drop("__place")
