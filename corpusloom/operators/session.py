"""Chat sessions as tables of turns (conv_id, turn, role, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import strip


def session_stats(turns: DataFrame) -> DataFrame:
    """Questions, responses, and the text of the last response, for each session."""
    bot = F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_questions"), F.count_if(bot).alias("n_responses"), F.max_by("text", F.when(bot, F.col("turn"))).alias("last_response"))


def ask(turns: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``turns`` with each session's question (conv_id, text), if it isn't blank, and its
    answer (conv_id, response, ok); a failed answer is a turn as well."""
    asked = questions.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = asked.join(last, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    user = at.select("conv_id", (F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), "text")
    bot = at.join(answers, "conv_id").select("conv_id", (F.col("last") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("response").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(user).unionByName(bot)


def clear(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """``turns`` without those up to each session's last clearing (conv_id, turn)."""
    last = cleared.groupBy("conv_id").agg(F.max("turn").alias("__until"))
    return turns.join(last, "conv_id", "left").filter(F.col("__until").isNull() | (F.col("turn") > F.col("__until"))).drop("__until")


def greet(sessions: DataFrame, turns: DataFrame, greeting: str) -> DataFrame:
    """A greeting as turn 0 of each session (conv_id) that has no turn."""
    empty = sessions.select("conv_id").distinct().join(turns.select("conv_id"), "conv_id", "left_anti")
    first = empty.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(greeting).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(first)


def topics(spark, table: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(table), "label string, detail string, query string")


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, html): turns in order, by role."""
    from .present import escape

    row = F.concat(F.lit('<div class="'), F.when(F.col("role") == "user", "user").otherwise("bot"), F.lit('">'), escape(F.coalesce("text", F.lit(""))), F.lit("</div>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("html")))), lambda s: s["html"]), "")
    return turns.groupBy("conv_id").agg(joined.alias("html"))


#: The last latency before any, the states of the pipeline, the mark before a latency.
NO_TIME, STATUS, BEFORE_ELAPSED = "—", ("OK", "ERR"), " · "
#: What a failed question is answered with; {} is the error.
FAILED = "⚠️ Terjadi kesalahan saat memproses pertanyaan:\n\n`{}`"


def process(turns: DataFrame, questions: DataFrame, answers: DataFrame, *, failed: str = FAILED) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, time, elapsed) with each session's question
    (conv_id, text, at), if it isn't blank, and its answer (conv_id, response, error, took,
    at): the response and the seconds it took, or what is said of an error, without a
    time taken. A question that has no answer failed. Sessions without turns begin at 0."""
    asked = questions.select("conv_id", strip(F.col("text")).alias("text"), F.col("at").alias("asked")).filter(F.col("text") != "")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = asked.join(last, "conv_id", "left").join(answers, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    clock = lambda at: F.date_format(at, "HH:mm")
    ok = F.col("error").isNull() & F.col("response").isNotNull()
    head, tail = failed.split("{}")
    said = F.when(ok, F.col("response")).otherwise(F.concat(F.lit(head), F.coalesce("error", F.lit("")), F.lit(tail)))
    user = rows.select("conv_id", (F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), "text", clock(F.col("asked")).alias("time"), F.lit("").alias("elapsed"))
    elapsed = F.when(ok & F.col("took").isNotNull(), F.format_string("%.1f", "took")).otherwise("")
    bot = rows.select("conv_id", (F.col("last") + 2).alias("turn"), F.lit("assistant").alias("role"), said.alias("text"), clock(F.coalesce("at", "asked")).alias("time"), elapsed.alias("elapsed"))
    return turns.select("conv_id", "turn", "role", "text", "time", "elapsed").unionByName(user).unionByName(bot)


def latency_stats(turns: DataFrame, connected: Column) -> DataFrame:
    """Questions, responses, the seconds that the last successful response took, and the
    state of the pipeline, for each session; a failed response counts and leaves the time
    as it was. ``connected`` is over the session's conv_id."""
    bot = F.col("role") == "assistant"
    took = F.when(bot & (F.coalesce("elapsed", F.lit("")) != ""), F.col("turn"))
    counts = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_questions"), F.count_if(bot).alias("n_responses"), F.coalesce(F.max_by("elapsed", took), F.lit(NO_TIME)).alias("last_time"))
    return counts.withColumn("status", F.when(connected, STATUS[0]).otherwise(STATUS[1]))


def timed_transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, html): turns in order, by role, each with its time and, behind it, the
    seconds a response took."""
    from .present import escape

    user, elapsed = F.col("role") == "user", F.coalesce("elapsed", F.lit(""))
    when = F.when(user | (elapsed == ""), F.coalesce("time", F.lit(""))).otherwise(F.concat(F.coalesce("time", F.lit("")), F.lit(BEFORE_ELAPSED), elapsed, F.lit("s")))
    shown = F.replace(escape(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br>"))
    row = F.concat(F.lit('<div class="'), F.when(user, "user").otherwise("bot"), F.lit('">'), shown, F.lit('<span class="time">'), when, F.lit("</span></div>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("html")))), lambda s: s["html"]), "")
    return turns.groupBy("conv_id").agg(joined.alias("html"))
