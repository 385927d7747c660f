"""Queries on sessions with times, on prompts, and on rendering that keeps its marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.frozen import scratch_folder
from corpusloom.operators import answer, present, session
from corpusloom.streaming import sessions

from .catalog import register, table
from .queries_search import _ESC, _blocks_sql, _marked, _MARKED_SQL
from .queries_text import quote

# Times by session and turn; every fifth response failed and has none.


def _timed(spark, d):
    n, at = F.col("conv_id") * 7 + F.col("turn"), F.timestamp_seconds(F.lit(1_704_096_000) + (F.col("conv_id") * 7 + F.col("turn")) * 60)
    took = F.format_string("%.1f", ((F.col("conv_id") * 13 + F.col("turn") * 7) % 90) / 10)
    elapsed = F.when((F.col("role") == "assistant") & (n % 5 > 0), took).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.date_format(at, "HH:mm").alias("time"), elapsed.alias("elapsed"))


_N = "(conv_id * 7 + turn)"
_CLOCK = "printf('%02d:%02d', ((8 * 60 + {0}) // 60) % 24, (8 * 60 + {0}) % 60)"
_TIMED_SQL = f"t AS (SELECT conv_id, turn, role, text, {_CLOCK.format(_N)} AS time, CASE WHEN role = 'assistant' AND {_N} % 5 > 0 THEN printf('%.1f', ((conv_id * 13 + turn * 7) % 90) / 10.0) ELSE '' END AS elapsed FROM conversations)"


@register("session_latency", f"WITH {_TIMED_SQL} SELECT conv_id, count(*) FILTER (role = 'user') AS n_questions, count(*) FILTER (role = 'assistant') AS n_responses, coalesce(arg_max(elapsed, turn) FILTER (role = 'assistant' AND elapsed <> ''), '—') AS last_time, CASE WHEN conv_id % 9 > 0 THEN 'OK' ELSE 'ERR' END AS status FROM t GROUP BY conv_id")
def session_latency(spark, d):
    return session.latency_stats(_timed(spark, d), F.col("conv_id") % 9 > 0)


_FAIL_SQL = "CASE WHEN conv_id % 3 = 0 THEN " + " || chr(10) || ".join(quote(x) for x in session.FAILED.replace("`{}`", "`bad {}`").split("\n")).replace("bad {}", "bad ' || conv_id || '") + " ELSE 'a ' || conv_id END"


@register("session_process", f"""WITH {_TIMED_SQL}, l AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0)
SELECT conv_id, turn, role, text, time, elapsed FROM t UNION ALL SELECT conv_id, n + 1, 'user', 'q ' || conv_id, {_CLOCK.format('conv_id')}, '' FROM l
UNION ALL SELECT conv_id, n + 2, 'assistant', {_FAIL_SQL}, {_CLOCK.format('(conv_id + 1)')}, CASE WHEN conv_id % 3 = 0 THEN '' ELSE printf('%.1f', (conv_id % 70) / 10.0) END FROM l""")
def session_process(spark, d):
    turns, c = _timed(spark, d), F.col("conv_id")
    at = lambda n: F.timestamp_seconds(F.lit(1_704_096_000) + n * 60)
    ids = turns.select("conv_id").distinct()
    asked = ids.select("conv_id", F.when(c % 2 == 0, F.concat(F.lit(" q "), c, F.lit("\n"))).otherwise(" \n").alias("text"), at(c).alias("at"))
    failed = c % 3 == 0
    said = ids.select("conv_id", F.when(~failed, F.concat(F.lit("a "), c)).alias("response"), F.when(failed, F.concat(F.lit("bad "), c)).alias("error"), ((c % 70) / 10).alias("took"), at(c + 1).alias("at"))
    return session.process(turns, asked, said)


@register("transcript_timed", f"""WITH {_TIMED_SQL} SELECT conv_id, string_agg('<div class="' || CASE WHEN role = 'user' THEN 'user' ELSE 'bot' END || '">' || replace({_ESC}, chr(10), '<br>') || '<span class="time">' || time || CASE WHEN elapsed <> '' THEN ' · ' || elapsed || 's' ELSE '' END || '</span></div>', '' ORDER BY turn) AS html FROM t GROUP BY conv_id""")
def transcript_timed(spark, d):
    return session.timed_transcript(_timed(spark, d))


@register("reference_entries_by_row", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE 'no. ' || conv_id || '|' || 'turn ' || turn || ' of ' || role END AS entries FROM conversations")
def reference_entries_by_row(spark, d):
    listed = F.concat(F.lit("\n\n📚  referensi (2):\n\n- no. "), "conv_id", F.lit("\n* turn "), "turn", F.lit(" of "), "role", F.lit("\n "))
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(listed))
    found = F.transform(present.reference_entries(text), lambda s: F.regexp_replace(s, r"^[*\-]\s*", ""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("entries"))


_ASKED = "chr(10) || 'Question: ' || text || chr(10)"


@register("prompts", f"""SELECT item_id, 'S.' || chr(10) || chr(10) || CASE item_id % 3
WHEN 0 THEN '[MODE: {answer.MODES[0]}]' || {_ASKED} || 'Say kindly that the question lies outside the subject, and offer to help within it.'
WHEN 1 THEN '[MODE: {answer.MODES[1]}]' || {_ASKED} || 'The corpus holds nothing on this. Answer from general knowledge and mark it as such.'
ELSE '[MODE: {answer.MODES[2]}]' || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'context ' || item_id ELSE '' END || {_ASKED} || 'Answer from the context and name the source of each statement.' END AS prompt FROM benchmark""")
def prompts(spark, d):
    k = F.col("item_id")
    mode = F.element_at(F.array(*map(F.lit, answer.MODES)), (k % 3 + 1).cast("int"))
    context = F.when(k % 2 == 0, F.concat(F.lit("context "), k))
    return table(spark, d, "benchmark").select("item_id", answer.build_prompt(mode, F.col("text"), context, system="S.").alias("prompt"))


@register("render_blocks_marked", f"WITH {_blocks_sql(_MARKED_SQL, strip_marks=False)} SELECT * FROM blocks")
def render_blocks_marked(spark, d):
    return present.blocks(table(spark, d, "conversations").select("conv_id", "turn", _marked().alias("text")), ["conv_id", "turn"], strip_marks=False)


@register("session_state", f"""WITH {_TIMED_SQL}, e AS (SELECT conv_id, turn // 3 AS epoch, turn, role, elapsed FROM t WHERE role IN ('user', 'assistant')),
l AS (SELECT conv_id, max(epoch) AS epoch FROM e GROUP BY conv_id), s AS (SELECT conv_id, l.epoch AS epoch, count(*) FILTER (role = 'user') AS q, count(*) FILTER (role = 'assistant') AS r, arg_max(elapsed, turn) FILTER (role = 'assistant' AND elapsed <> '') AS took FROM e JOIN l USING (conv_id) WHERE e.epoch = l.epoch GROUP BY ALL)
SELECT conv_id, epoch + (conv_id % 5 = 0)::INT AS epoch, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE q END AS n_questions, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE r END AS n_responses, CASE WHEN conv_id % 5 = 0 THEN '—' ELSE coalesce(took, '—') END AS last_time, conv_id % 5 = 0 AS greet, CASE WHEN conv_id % 9 > 0 THEN 'OK' ELSE 'ERR' END AS status FROM s""", longs=("epoch", "n_questions", "n_responses"))
def session_state(spark, d):
    """A session begins anew at every third turn, and every fifth one is cleared at its end;
    its events come in two parts, each followed by the stream."""
    path, turns = scratch_folder(spark, "sessions"), _timed(spark, d).filter(F.col("role").isin("user", "assistant"))
    events = turns.select("conv_id", F.floor(F.col("turn") / 3).alias("epoch"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("kind"), "elapsed")
    cleared = events.filter(F.col("conv_id") % 5 == 0).select("conv_id", (F.col("epoch") + 1).alias("epoch"), "turn", F.lit("clear").alias("kind"), F.lit("").alias("elapsed"))
    events = events.unionByName(cleared)
    for part in (F.col("turn") % 4 < 2, F.col("turn") % 4 >= 2):
        events.filter(part).write.mode("append").parquet(f"{path}/events")
        sessions.follow(spark, f"{path}/events", f"{path}/states", f"{path}/mark").awaitTermination()
    return sessions.shown(sessions.states(spark, f"{path}/states"), F.col("conv_id") % 9 > 0)
