r"""Secret scans in DataFrame functions alone.

Base spans come from three fixed patterns. Further ones are runs of key characters
whose log-likelihood ratio, under character Markov models of random strings and of
ordinary identifiers, exceeds the log of the prior odds. Both models are bigram
counts over labelled samples; at most ``TRAIN_DOCS`` different texts, those of the least
digests, give the ordinary identifiers, and a generator gives the random strings.

Defined results: a null text is empty; a null doc_id passes through; repeated rows
each get their result; spans of one start stand in the order of the kinds, and a ratio
of just the bound is no span; texts of any length are scanned whole; an empty table
gives an empty result (its ordinary model is then smoothing alone). ``scan_secrets``
keeps other columns, but for ``base_spans`` and ``markov_spans``, which the result's own
replace; the query ignores them. Positions count code points, the end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import let

from . import draw
from .scratch import column

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these either fails as a whole or is taken as a whole, so the least length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS = 6
#: Candidates of the Markov models.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # state 0: any other character
TRAIN_DOCS, TRAIN_RANDOM, PRIOR_ODDS = 2_000, 4_000, 1e4
#: Items folded before their rows are appended to those of the items before.
BLOCK = 256


def _none(fields: str = "start:int,kind:int,end:int") -> Column:
    return F.array().cast(f"array<struct<{fields}>>")


def _scan(items: Column, state: Column, fields: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A fold that gives rows: ``step`` makes of the state and an item the next state and
    an array of rows. Returns (s, out), the last state and all rows.

    Appending copies what is there, so items are folded in blocks of ``BLOCK`` and their
    rows appended block by block: the cost grows with n to the power of 1.5 at worst, with
    a small factor, where appending one by one would square it."""

    def one(acc: Column, x: Column) -> Column:
        state, rows = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], rows).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        part = F.aggregate(some, F.struct(acc["s"].alias("s"), _none(fields).alias("out")), one)
        return let(part, lambda p: F.struct(p["s"].alias("s"), F.concat(acc["out"], p["out"]).alias("out")))

    first = F.struct(state.alias("s"), _none(fields).alias("out"))
    blocks = lambda all_of_them: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of_them) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_of_them, k * BLOCK + 1, BLOCK))
    return let(items, lambda all_of_them: F.when(F.size(all_of_them) > 0, F.aggregate(blocks(all_of_them), first, block)).otherwise(first))


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the matches that ``keep`` accepts; texts between matches give the positions."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), (m.isNotNull() & keep(m)).alias("ok")),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["gap"], at + x["gap"] + x["n"]
        return end, F.when(x["ok"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(_none())

    return _scan(parts, F.lit(0), "start:int,kind:int,end:int", step)["out"]


def _merged(spans: Column, touching: bool) -> Column:
    """Sorted spans as stretches (lo, hi) of those that overlap or, if asked for, touch."""
    fields = "lo:int,hi:int"

    def step(now: Column, x: Column) -> tuple[Column, Column]:
        more = x["start"] <= now["hi"] if touching else x["start"] < now["hi"]
        grown = F.struct(now["lo"].alias("lo"), F.greatest(now["hi"], x["end"]).alias("hi"))
        new = F.struct(x["start"].alias("lo"), x["end"].alias("hi"))
        return F.when(more, grown).otherwise(new), F.when(more | (now["lo"] < 0), _none(fields)).otherwise(F.array(now))

    begin = F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    return let(_scan(spans, begin, fields, step), lambda r: F.when(r["s"]["lo"] < 0, r["out"]).otherwise(F.concat(r["out"], F.array(r["s"]))))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the three base patterns, by start and kind."""
    none = _none()
    low = F.lower(text)
    named = F.contains(low, F.lit(ASSIGN_WORDS[0]))
    for word in ASSIGN_WORDS[1:]:
        named = named | F.contains(low, F.lit(word))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS
    assign = F.when(named, _spans(text, ASSIGN, 0, long_enough)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, lambda m: F.lit(True))).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2, lambda m: F.lit(True))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _states(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(token: Column) -> Column:
    """The transitions of a token, each as one number."""
    states = _states(token)
    n = F.length(token) - 1
    return F.zip_with(F.slice(states, 1, n), F.slice(states, 2, n), lambda a, b: a * STATES + b)


def _number(text: Column) -> Column:
    """A number under 2^28 from a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def ordinary_tokens(docs: DataFrame, text_col: str, rows: int = TRAIN_DOCS) -> DataFrame:
    """Ordinary identifiers: words of at most ``rows`` texts, those of the least digests,
    alone and joined in pairs as identifiers, paths and versions are, and numbers. A text
    that many rows repeat is drawn once."""
    texts = docs.select(column(text_col).alias("t")).filter(F.col("t").isNotNull()).withColumn("h", F.md5("t"))
    few = F.conv(F.substring("h", 1, 7), 16, 10).cast("long") < math.ceil(draw.share(rows, docs.count()) * 16**7)
    texts = draw.least(texts.filter(few), "h", rows)
    words = F.expr("filter(split(t, '[^\\\\p{L}]+'), w -> length(w) > 1)")
    pairs = texts.select(words.alias("w")).filter(F.size("w") > 2).select(F.posexplode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("i", "p"))
    a, b, i = F.col("p.a"), F.col("p.b"), F.pmod("i", F.lit(8))
    upper = lambda c: F.translate(c, ALPHABET[:26], ALPHABET[26:52])
    numbers = F.concat(_number(F.concat(a, F.lit("/"), b)).cast("string"), F.lit("-"), _number(F.concat(b, F.lit("/"), a)).cast("string"))
    joined = F.when(i == 0, F.concat(a, F.lit("_"), b)).when(i == 1, F.concat(a, upper(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b)))).when(i == 2, F.concat(a, F.lit("/"), b)).when(i == 3, F.concat(a, F.lit("-"), b)).when(i == 4, upper(F.concat(a, F.lit("_"), b))).when(i == 5, numbers).when(i == 6, F.concat(a, b)).otherwise(a)
    return pairs.select(joined.alias("token"), F.lit(0).alias("label"))


def random_tokens(spark: SparkSession, n: int = TRAIN_RANDOM, seed: int = 7) -> DataFrame:
    """Random strings: hexadecimal, Base64 and its web form, letters with digits."""
    raw = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(raw))
    kind = F.pmod("id", F.lit(4))
    token = F.when(kind == 0, raw).when(kind == 1, b64).when(kind == 2, F.translate(b64, "+/=", "-_")).otherwise(F.translate(b64, "+/=", ""))
    return spark.range(n).select(token.alias("token"), F.lit(1).alias("label"))


def train_markov(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, random over ordinary, from
    (token, label); what comes to the driver is a count for each transition and label."""
    steps = labelled.filter(F.length("token") > 1).select("label", F.explode(_steps(F.col("token"))).alias("step"))
    counts = [[0.5] * (STATES * STATES) for _ in range(2)]
    for label, step, n in steps.groupBy("label", "step").count().collect():
        counts[label][step] += n
    rows = [[sum(c[s * STATES : (s + 1) * STATES]) for s in range(STATES)] for c in counts]
    return [math.log(counts[1][k] / rows[1][k // STATES]) - math.log(counts[0][k] / rows[0][k // STATES]) for k in range(STATES * STATES)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """The token's log-likelihood ratio, random over ordinary."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(_steps(token), F.lit(0.0), lambda total, step: total + F.get(table, step))


def markov_spans(text: Column, model: list[float], base: Column, prior_odds: float = PRIOR_ODDS) -> Column:
    """Spans of random-looking runs that the base spans, sorted, don't cover whole."""
    runs = F.when(text.rlike(RUN), _spans(text, RUN, 3, lambda m: likelihood_ratio(m, model) > math.log(prior_odds))).otherwise(_none())

    def uncovered(found: Column) -> Column:
        # stretches of base spans and runs in one order; of the former only the last can cover a run
        covers = F.transform(_merged(base, touching=True), lambda m: F.struct(m["lo"].alias("start"), F.lit(-1).alias("kind"), m["hi"].alias("end")))
        step = lambda hi, x: (F.when(x["kind"] < 0, x["end"]).otherwise(hi), F.when((x["kind"] >= 0) & (hi < x["end"]), F.array(x)).otherwise(_none()))
        return _scan(F.array_sort(F.concat(covers, found)), F.lit(-1), "start:int,kind:int,end:int", step)["out"]

    return let(runs, lambda found: F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(uncovered(found)))


def train_on(docs: DataFrame, *, text_col: str = "text") -> list[float]:
    return train_markov(ordinary_tokens(docs, text_col).unionByName(random_tokens(docs.sparkSession)))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """``docs`` with the array columns ``base_spans`` and ``markov_spans``."""
    model = model or train_on(docs, text_col=text_col)
    text = F.coalesce(column(text_col), F.lit(""))
    found = docs.withColumn("base_spans", base_spans(text))
    return found.withColumn("markov_spans", markov_spans(text, model, F.col("base_spans")))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with sorted spans replaced; spans that overlap become one mark."""

    def pieces(found: Column) -> Column:
        behind = lambda i: F.when(i > 0, F.get(found, i - 1)["hi"]).otherwise(0)  # noqa: E731  where the stretch before ends

        def block(k: Column) -> Column:
            begin, some = behind(k * BLOCK), F.slice(found, k * BLOCK + 1, BLOCK)
            end = F.get(found, F.least((k + 1) * BLOCK, F.size(found)) - 1)["hi"]
            # a place in a text is found from its start, so each block is cut out first
            cut = lambda part: F.transform(some, lambda m, i: F.concat(F.substring(part, behind(k * BLOCK + i) - begin + 1, m["lo"] - behind(k * BLOCK + i)), F.lit(mark)))
            return let(F.substring(text, begin + 1, end - begin), cut)

        whole = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), block))
        return F.concat(F.array_join(whole, ""), F.substring(text, F.element_at(found, -1)["hi"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(_merged(spans, touching=False), pieces))


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    every = F.array_sort(F.concat("base_spans", "markov_spans"))
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base_spans")), 256).alias("base_sha256"), _digest(every).alias("spans"), F.size("markov_spans").cast("long").alias("n_markov"))


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql_matches(kind: int, pattern: str) -> str:
    return f"SELECT r, {kind} AS kind, unnest(regexp_split_to_array(t, '{pattern}')) AS gap, unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS m, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i FROM d WHERE regexp_matches(t, '{pattern}')"


# RE2 folds letters beyond ASCII as well, so the names are spelt out; and a greedy run of
# at least so many characters begins where a run does, so it needs no look-behind.
_ASSIGN_SQL = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_STEP_SQL = f"strpos('{ALPHABET}', substr(m, k, 1)) * {STATES} + strpos('{ALPHABET}', substr(m, k + 1, 1))"
_UPPER_SQL = f"'{ALPHABET[:26]}', '{ALPHABET[26:52]}'"
_NUMBER_SQL = "('0x' || substr(md5({}), 1, 7))::BIGINT"
_TOKEN_SQL = " ".join(
    f"WHEN {k} THEN {t}"
    for k, t in enumerate([
        "a || '_' || b", f"a || translate(left(b, 1), {_UPPER_SQL}) || substr(b, 2)", "a || '/' || b", "a || '-' || b", f"translate(a || '_' || b, {_UPPER_SQL})",
        _NUMBER_SQL.format("a || '/' || b") + " || '-' || " + _NUMBER_SQL.format("b || '/' || a"), "a || b", "a",
    ])
)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
src AS (SELECT md5(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL AND {_NUMBER_SQL.format("text")} < (SELECT ceil(least(1.0, {2.0 * TRAIN_DOCS} / greatest(count(*), 1)) * {16**7}) FROM documents) GROUP BY 1 ORDER BY h LIMIT {TRAIN_DOCS}),
ws AS (SELECT list_filter(regexp_split_to_array(t, '[^\\p{{L}}]+'), lambda w: length(w) > 1) AS w FROM src),
ps AS (SELECT i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT w, unnest(range(0, len(w) - 1)) AS i FROM ws WHERE len(w) > 2)),
raw AS (SELECT i, sha256('7/' || i) AS x, to_base64(unhex(sha256('7/' || i))) AS y FROM range({TRAIN_RANDOM}) g(i)),
tokens AS (SELECT 0 AS label, CASE i % 8 {_TOKEN_SQL} END AS m FROM ps UNION ALL SELECT 1, CASE i % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN translate(y, '+/=', '-_') ELSE translate(y, '+/=', '') END FROM raw),
steps AS (SELECT label, {_STEP_SQL} AS step FROM (SELECT label, m, unnest(range(1, length(m))) AS k FROM tokens)),
counted AS (SELECT label, step, count(*) AS n FROM steps GROUP BY ALL),
every AS (SELECT l AS label, s AS step, s // {STATES} AS state, 0.5 + coalesce(n, 0) AS c FROM range(2) a(l) CROSS JOIN range({STATES**2}) b(s) LEFT JOIN counted ON label = l AND step = s),
logs AS (SELECT label, step, ln(c / sum(c) OVER (PARTITION BY label, state)) AS x FROM every),
model AS (SELECT a.step AS step, printf('%.5f', b.x - a.x)::DOUBLE AS x FROM logs a JOIN logs b ON a.step = b.step AND a.label = 0 AND b.label = 1),
ms AS ({" UNION ALL ".join(_sql_matches(k, p) for k, p in enumerate((_ASSIGN_SQL, ACCESS, HEX, "[A-Za-z0-9+/_=-]{20,}")))}),
spans AS (SELECT r, kind, m, (sum(length(gap)) OVER upto + coalesce(sum(length(m)) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lo FROM ms WINDOW upto AS (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
base AS (SELECT r, list_sort(list({{'lo': lo, 'kind': kind, 'hi': lo + length(m)}})) AS base FROM spans WHERE m IS NOT NULL AND kind < 3 AND (kind > 0 OR length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= {ASSIGN_CHARS}) GROUP BY r),
likely AS (SELECT r, lo, any_value(n) AS n FROM (SELECT r, lo, length(m) AS n, {_STEP_SQL} AS step FROM (SELECT r, lo, m, unnest(range(1, length(m))) AS k FROM spans WHERE kind = 3 AND m IS NOT NULL)) JOIN model USING (step) GROUP BY r, lo HAVING sum(x) > ln({PRIOR_ODDS})),
found AS (SELECT d.doc_id AS doc_id, r, coalesce(base, []) AS base, coalesce(more, []) AS more FROM d LEFT JOIN base USING (r)
  LEFT JOIN (SELECT r, list({{'lo': lo, 'kind': 3, 'hi': lo + n}} ORDER BY lo) AS more FROM likely GROUP BY r) USING (r)),
kept AS (SELECT doc_id, base, list_filter(more, lambda x: list_reduce(list_transform(base, lambda y: [y.lo, y.hi]), lambda c, y: CASE WHEN y[1] <= c[1] THEN [greatest(c[1], y[2]), 0] ELSE c END, [x.lo, 0])[1] < x.hi) AS more FROM found),
named AS (SELECT *, list_transform(base, lambda s: ['assign', 'access', 'hex'][s.kind + 1] || ':' || s.lo || ':' || s.hi) AS names, list_transform(list_sort(list_concat(base, more)), lambda s: ['assign', 'access', 'hex', 'markov'][s.kind + 1] || ':' || s.lo || ':' || s.hi) AS whole FROM kept)
SELECT doc_id, {", ".join(f"len(list_filter(base, lambda s: s.kind = {k}))::BIGINT AS n_{KINDS[k]}" for k in range(3))}, sha256(array_to_string(names, ',')) AS base_sha256, array_to_string(whole, ',') AS spans, len(more)::BIGINT AS n_markov FROM named
"""

QUERIES = {"op9_secret_scans": op9_secret_scans}
ORACLES = {"op9_secret_scans": ORACLE}
