"""Queries on cleaning, normalisation, segmentation, enrichment and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import clean
from corpusloom.functions.embed import embed_text
from corpusloom.functions.tokens import word_count
from corpusloom.operators import enrich, postings, segment

from .catalog import register, table

NL = "chr(10)"


def sql_words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def sql_strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def quote(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


# Marks that the documents lack, so that each cleaning step has something to do.


def _noisy():
    return F.concat(F.lit("﻿\x01"), F.col("text"), F.lit("\n====  \n\n\n•  satu  dua – tiga ‛x„  \r\n- \n\n\n\nempat\tlima \t"))

_NOISY_SQL = f"(chr(65279) || chr(1) || text || {NL} || '====  ' || repeat({NL}, 3) || '•  satu  dua – tiga ‛x„  ' || chr(13) || {NL} || '- ' || repeat({NL}, 4) || 'empat' || chr(9) || 'lima ' || chr(9))"


def _clean_sql(t: str) -> str:
    t = f"regexp_replace(nfc_normalize({t}), '^' || chr(65279) || '+', '')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    t = rf"regexp_replace({t}, '(?m)^[=\-*#~]{{3,}}\s*$', '', 'g')"
    t = rf"regexp_replace(replace(replace({t}, chr(13) || {NL}, {NL}), chr(13), {NL}), '(?m)[^\S\n]+$', '', 'g')"
    t = f"translate({t}, '‛‟„–—', '''\"\"--')"
    t = rf"regexp_replace({t}, '(?m)^[•●▪▸→►✓✔-]\s+', '- ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', repeat({NL}, 2), 'g')"
    return sql_strip(f"replace({t}, chr(9), ' ')")


@register("clean_text", f"SELECT doc_id, {_clean_sql(_NOISY_SQL)} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.clean_text(_noisy()).alias("cleaned"))


def _numbers_sql(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '(\d)\.(\d{{3}})(\D|$)', '\1\2\3', 'g'), '(\d),(\d)', '\1.\2', 'g')"


_URL, _MAIL = r"https?://\S+|www\.\S+", r"\S+@\S+\.\S+"


def _html_sql(t: str) -> str:
    t = f"regexp_replace(nfc_normalize({t}), '<[^>]+>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{_URL}', '[URL]', 'g'), '{_MAIL}', '[EMAIL]', 'g')"
    return sql_strip(f"regexp_replace(regexp_replace({_numbers_sql(t)}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', repeat({NL}, 2), 'g')")


@register("clean_html_pages", f"SELECT page_id, {_html_sql('html')} AS cleaned FROM pages")
def clean_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", clean.clean_html_text(F.col("html")).alias("cleaned"))


@register("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", clean.remove_html(F.col("html")).alias("stripped"))


@register("mask_urls", f"SELECT page_id, regexp_replace(url || ' ' || html, '{_URL}', '[URL]', 'g') AS masked FROM pages")
def mask_urls(spark, d):
    return table(spark, d, "pages").select("page_id", clean.mask_urls(F.concat("url", F.lit(" "), "html")).alias("masked"))


@register("mask_emails", f"SELECT doc_id, regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g') AS masked FROM documents")
def mask_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.mask_emails(F.col("text")).alias("masked"))


@register("clean_numbers", f"SELECT doc_id, {_numbers_sql('text')} AS cleaned FROM documents")
def clean_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.clean_numbers(F.col("text")).alias("cleaned"))


@register("normalize_whitespace", "SELECT page_id, " + sql_strip(f"regexp_replace(regexp_replace(html, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', repeat({NL}, 2), 'g')") + " AS cleaned FROM pages")
def normalize_whitespace(spark, d):
    return table(spark, d, "pages").select("page_id", clean.normalize_whitespace(F.col("html")).alias("cleaned"))


@register("strip_special", r"""SELECT page_id, regexp_replace(html, '[^\p{L}\p{M}\p{N}_\s.,;:!?()\-''"/%°]', '', 'g') AS kept, regexp_replace(html, '[^\p{L}\p{M}\p{N}_\s]', '', 'g') AS bare FROM pages""")
def strip_special(spark, d):
    return table(spark, d, "pages").select("page_id", clean.remove_special(F.col("html")).alias("kept"), clean.remove_special(F.col("html"), keep_punctuation=False).alias("bare"))


_UNITS_TAIL = " 2500g 180cm 12mg 5 ml 7% 30kkal 3m 9mcgx Gisi STUNTIG balits ASI MPASI TTD BB/TB Hb"


def _units_sql(t: str) -> str:
    for names, whole in lexicon.UNITS:
        t = rf"regexp_replace({t}, '(\d+)({names})" + (r"\b" if whole else "") + r"', '\1 \2', 'g')"
    return t


def _typos_sql(t: str) -> str:
    for a, b in lexicon.TYPOS:
        t = rf"regexp_replace({t}, '(?i)\b{a}\b', '{b}', 'g')"
    return t


def _abbreviations_sql(t: str) -> str:
    for a, b in lexicon.ABBREVIATIONS:
        t = rf"regexp_replace({t}, '\b{a}\b', '{b} ({a})', 'g')"
    return t


@register("normalize_units", f"SELECT doc_id, {_units_sql(f'text || {quote(_UNITS_TAIL)}')} AS normal FROM documents")
def normalize_units(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.space_units(F.concat("text", F.lit(_UNITS_TAIL)), lexicon.UNITS).alias("normal"))


@register("fix_typos", f"SELECT doc_id, {_typos_sql(f'text || {quote(_UNITS_TAIL)}')} AS normal FROM documents")
def fix_typos(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.fix_typos(F.concat("text", F.lit(_UNITS_TAIL)), lexicon.TYPOS).alias("normal"))


@register("expand_abbreviations", f"SELECT doc_id, {_abbreviations_sql(f'text || {quote(_UNITS_TAIL)}')} AS normal FROM documents")
def expand_abbreviations(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.expand_abbreviations(F.concat("text", F.lit(_UNITS_TAIL)), lexicon.ABBREVIATIONS).alias("normal"))


@register("normalize_text", "SELECT doc_id, " + _typos_sql(_units_sql(_abbreviations_sql(f"text || {quote(_UNITS_TAIL)}"))) + " AS normal FROM documents")
def normalize_text(spark, d):
    text = F.concat("text", F.lit(_UNITS_TAIL))
    return table(spark, d, "documents").select("doc_id", clean.normalize_text(text, abbreviations=lexicon.ABBREVIATIONS, units=lexicon.UNITS, typos=lexicon.TYPOS).alias("normal"))


_SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1␞\2', 'g'), '␞'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@register("sentences", f"WITH s AS (SELECT doc_id, {_SENTENCES_SQL} AS ss FROM documents) SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s", longs=("pos",))
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("pos", "sentence"))


_PARAGRAPHS_SQL = rf"list_filter(list_transform(string_split(text, {NL}), lambda p: {sql_strip('p')}), lambda p: p <> '')"


@register("paragraphs", f"WITH s AS (SELECT doc_id, {_PARAGRAPHS_SQL} AS ps FROM documents) SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS pos FROM s", longs=("pos",))
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.paragraphs(F.col("text"), "\n")).alias("pos", "paragraph"))


def _tail_sql(t: str, n: int) -> str:
    w = sql_words(t)
    return f"CASE WHEN len({w}) <= {n} THEN {t} ELSE array_to_string(list_slice({w}, len({w}) - {n - 1}, len({w})), ' ') END"


@register("overlap_tail", f"SELECT doc_id, {_tail_sql('text', 50)} AS tail FROM documents")
def overlap_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", segment.overlap_tail(F.col("text"), 50).alias("tail"))


def _chunks_sql(parts: str, joint: str) -> str:
    joined = f"CASE WHEN a.buffer <> '' THEN a.buffer || {joint} || x.p ELSE x.p END"
    fits = f"len({sql_words(joined)}) <= 200"
    tail = _tail_sql("a.buffer", 50)
    after = f"CASE WHEN ({tail}) <> '' THEN {sql_strip(f'({tail}) || {joint} || x.p')} ELSE x.p END"
    step = f"{{'p': '', 'buffer': CASE WHEN {fits} THEN {joined} ELSE {after} END, 'out': CASE WHEN NOT ({fits}) AND length(a.buffer) >= 50 THEN list_append(a.out, a.buffer) ELSE a.out END}}"
    return f"list_reduce(list_transform({parts}, lambda p: {{'p': p, 'buffer': '', 'out': []::VARCHAR[]}}), lambda a, x: {step}, {{'p': '', 'buffer': '', 'out': []::VARCHAR[]}})"


@register("chunk_words", f"WITH f AS (SELECT doc_id, {_chunks_sql(_PARAGRAPHS_SQL, f'repeat({NL}, 2)')} AS r FROM documents), c AS (SELECT doc_id, CASE WHEN length(r.buffer) >= 50 THEN list_append(r.out, r.buffer) ELSE r.out END AS cs FROM f) SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS pos FROM c", longs=("pos",))
def chunk_words(spark, d):
    parts = segment.paragraphs(F.col("text"), "\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.chunk_words(parts)).alias("pos", "chunk"))


_CHARS_STEP = "{'p': '', 'now': CASE WHEN length(a.now) + length(x.p) < 600 THEN a.now || x.p || ' ' WHEN length(a.now) > 120 THEN right(a.now, 120) || x.p || ' ' ELSE x.p || ' ' END, 'out': CASE WHEN length(a.now) + length(x.p) >= 600 AND a.now <> '' THEN list_append(a.out, " + sql_strip("a.now") + ") ELSE a.out END}"
_CHARS_FOLD = f"list_reduce(list_transform({_PARAGRAPHS_SQL}, lambda p: {{'p': p, 'now': '', 'out': []::VARCHAR[]}}), lambda a, x: {_CHARS_STEP}, {{'p': '', 'now': '', 'out': []::VARCHAR[]}})"


@register("chunk_chars", f"WITH f AS (SELECT doc_id, {_CHARS_FOLD} AS r FROM documents), c AS (SELECT doc_id, CASE WHEN r.now <> '' THEN list_append(r.out, {sql_strip('r.now')}) ELSE r.out END AS cs FROM f) SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS pos FROM c", longs=("pos",))
def chunk_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.chunk_chars(F.col("text"))).alias("pos", "chunk"))


def _headed():
    return F.concat(F.lit("lost\n[SEKSI 1] Judul satu\n"), F.col("text"), F.lit("\n[seksi 22] Judul dua\nlead\nA. Bagian satu\n"), F.right("text", F.lit(300)), F.lit("\nB. Kosong\nC. Bagian tiga\nakhir"))

_HEADED_SQL = f"('lost' || {NL} || '[SEKSI 1] Judul satu' || {NL} || text || {NL} || '[seksi 22] Judul dua' || {NL} || 'lead' || {NL} || 'A. Bagian satu' || {NL} || right(text, 300) || {NL} || 'B. Kosong' || {NL} || 'C. Bagian tiga' || {NL} || 'akhir')"
_SECTIONS_SQL = rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace({_HEADED_SQL}, '(?i)\[SEKSI\s+(\d+)\]\s+', '␞\1␟', 'g'), '␞')[2:] AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM t)
SELECT doc_id, pos, string_split(part, '␟')[1] AS num, {sql_strip(f"string_split({sql_strip("string_split(part, '␟')[2]")}, {NL})[1]")} AS title, {sql_strip("string_split(part, '␟')[2]")} AS body FROM s"""


@register("sections", _SECTIONS_SQL, longs=("pos",))
def sections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(segment.sections(_headed())).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.num", "s.title", "s.body")


_SUB_SQL = rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace({_HEADED_SQL}, '(?m)^([A-Z]\.\s+.+)$', '␞\1␞', 'g'), '␞') AS m FROM documents),
p AS (SELECT doc_id, 0 AS i, 'Pendahuluan' AS label, {sql_strip('m[1]')} AS text FROM t UNION ALL SELECT doc_id, i, {sql_strip('m[2 * i]')}, {sql_strip('m[2 * i + 1]')} FROM t, LATERAL (SELECT unnest(range(1, len(m) // 2 + 1)) AS i))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, label, text FROM p WHERE text <> ''"""


@register("subsections", _SUB_SQL, longs=("pos",))
def subsections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(segment.subsections(_headed())).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.label", "s.text")


_SPACED_SQL = f"replace({_HEADED_SQL}, {NL}, repeat({NL}, 2))"
_BODY_PARAGRAPHS_SQL = rf"list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
_CHUNK_DOCUMENTS_SQL = rf"""WITH t AS (SELECT doc_id, source, {_SPACED_SQL} AS text FROM documents),
h AS (SELECT doc_id, source, text, string_split(regexp_replace(text, '(?i)\[SEKSI\s+(\d+)\]\s+', '␞\1␟', 'g'), '␞')[2:] AS parts FROM t),
s AS (SELECT doc_id, source, text, s, string_split(part, '␟')[1] AS num, {sql_strip("string_split(part, '␟')[2]")} AS raw FROM (SELECT doc_id, source, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS s FROM h)),
m AS (SELECT *, 'SEKSI ' || num || ': ' || {sql_strip(f"string_split(raw, {NL})[1]")} AS section, string_split(regexp_replace(raw, '(?m)^([A-Z]\.\s+.+)$', '␞\1␞', 'g'), '␞') AS m FROM s),
u AS (SELECT doc_id, source, text, s, 0 AS u, section, CASE WHEN len(m) < 2 THEN 'Umum' ELSE 'Pendahuluan' END AS label, CASE WHEN len(m) < 2 THEN raw ELSE {sql_strip('m[1]')} END AS body FROM m
  UNION ALL SELECT doc_id, source, text, s, i, section, {sql_strip('m[2 * i]')}, {sql_strip('m[2 * i + 1]')} FROM m, LATERAL (SELECT unnest(range(1, len(m) // 2 + 1)) AS i)),
f AS (SELECT *, {_chunks_sql(_BODY_PARAGRAPHS_SQL, f'repeat({NL}, 2)')} AS r FROM u WHERE body <> ''),
c AS (SELECT *, CASE WHEN length(r.buffer) >= 50 THEN list_append(r.out, r.buffer) ELSE r.out END AS cs FROM f),
x AS (SELECT doc_id, source, text, s, u, section, label, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS k FROM c),
y AS (SELECT *, greatest(0, instr(text, left(chunk, 50)) - 1) AS begins, row_number() OVER (PARTITION BY doc_id ORDER BY s, u, k) AS no FROM x)
SELECT doc_id, source AS source_file, section, label AS subsection, {sql_strip('chunk')} AS text, begins AS char_start, begins + length(chunk) AS char_end, len({sql_words('chunk')}) AS token_count, no AS chunk_no, 'chunk_' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 4, '0') ELSE no::VARCHAR END AS chunk_id FROM y"""


@register("chunk_documents", _CHUNK_DOCUMENTS_SQL, longs=("char_start", "char_end", "token_count", "chunk_no"))
def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace(_headed(), F.lit("\n"), F.lit("\n\n")).alias("text"), "source")
    return segment.chunk_documents(docs, source_col="source")


# The default lexicon, and categories that occur in the test documents.
_TAGS = {**lexicon.DOMAIN_KEYWORDS, "rights": ["rights reserved", "license"], "token": ["token", "secret"], "the": ["the ", "and "], "und": ["und ", "der "]}


def _any_sql(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {quote(x)})" for x in terms) + ")"


@register("keyword_tags", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_any_sql('lower(text)', v)} THEN '{k}' END" for k, v in _TAGS.items()) + "], lambda x: x IS NOT NULL)), ',') AS tags FROM documents")
def keyword_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(enrich.keyword_tags(F.col("text"), _TAGS), ",").alias("tags"))


# What ingesting the documents gives: cleaned, normalised, cut and tagged.
_INGESTED_SQL = _typos_sql(_units_sql(_abbreviations_sql(_clean_sql("text"))))
_TAGS_SQL = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_any_sql('lower(text)', v)} THEN '{k}' END" for k, v in lexicon.DOMAIN_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)), ',')"
CORPUS_CHUNKS_SQL = rf"""WITH t AS (SELECT doc_id, source, {_INGESTED_SQL} AS text FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, source, text, string_split(regexp_replace(text, '(?i)\[SEKSI\s+(\d+)\]\s+', '␞\1␟', 'g'), '␞')[2:] AS found FROM t),
p AS (SELECT doc_id, source, text, len(found) = 0 AS whole, CASE WHEN len(found) = 0 THEN ['0␟'] ELSE found END AS parts FROM h),
s AS (SELECT doc_id, source, text, whole, s, string_split(part, '␟')[1] AS num, CASE WHEN whole THEN text ELSE {sql_strip("string_split(part, '␟')[2]")} END AS raw FROM (SELECT doc_id, source, text, whole, unnest(parts) AS part, generate_subscripts(parts, 1) AS s FROM p)),
m AS (SELECT *, 'SEKSI ' || num || ': ' || CASE WHEN whole THEN {quote(segment.WHOLE)} ELSE {sql_strip(f"string_split(raw, {NL})[1]")} END AS section, string_split(regexp_replace(raw, '(?m)^([A-Z]\.\s+.+)$', '␞\1␞', 'g'), '␞') AS m FROM s),
u AS (SELECT doc_id, source, text, s, 0 AS u, section, CASE WHEN len(m) < 2 THEN 'Umum' ELSE 'Pendahuluan' END AS label, CASE WHEN len(m) < 2 THEN raw ELSE {sql_strip('m[1]')} END AS body FROM m
  UNION ALL SELECT doc_id, source, text, s, i, section, {sql_strip('m[2 * i]')}, {sql_strip('m[2 * i + 1]')} FROM m, LATERAL (SELECT unnest(range(1, len(m) // 2 + 1)) AS i)),
f AS (SELECT *, {_chunks_sql(_BODY_PARAGRAPHS_SQL, f'repeat({NL}, 2)')} AS r FROM (SELECT * FROM u WHERE len({_BODY_PARAGRAPHS_SQL}) > 0)),
c AS (SELECT *, CASE WHEN length(r.buffer) >= 50 THEN list_append(r.out, r.buffer) ELSE r.out END AS cs FROM f),
x AS (SELECT doc_id, source, text AS whole_text, s, u, section, label, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS k FROM c),
y AS (SELECT *, greatest(0, instr(whole_text, left(chunk, 50)) - 1) AS begins, row_number() OVER (PARTITION BY doc_id ORDER BY s, u, k) AS no FROM x),
z AS (SELECT doc_id, source, no, section, label, {sql_strip('chunk')} AS text, begins, begins + length(chunk) AS ends, len({sql_words('chunk')}) AS n FROM y)
SELECT doc_id, source, coalesce(nullif(source, ''), 'none') AS part, doc_id || '_chunk_' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 4, '0') ELSE no::VARCHAR END AS chunk_id, section, label AS subsection, text, no AS chunk_no, begins AS char_start, ends AS char_end, n AS token_count,
  {_TAGS_SQL} AS keywords, regexp_matches(text, '\d') AS has_numbers, regexp_matches(text, '(?m)^\s*-\s') AS has_list, CASE WHEN contains(lower(text), 'kendari') THEN 'kendari_sultra' ELSE 'nasional' END AS location FROM z"""


@register("chunk_metadata", rf"SELECT doc_id, regexp_matches(text, '\d') AS has_numbers, regexp_matches(text, '(?m)^\s*-\s') AS has_list, len({sql_words('text')}) AS word_count, length(text) AS char_count, 'id' AS language, 'stunting_health' AS domain, CASE WHEN contains(lower(text), 'kendari') THEN 'kendari_sultra' ELSE 'nasional' END AS location, '[Sumber: ' || source || ' | ' || lang || ']' || {NL} || text AS display_text FROM documents", longs=("word_count", "char_count",))
def chunk_metadata(spark, d):
    return table(spark, d, "documents").select("doc_id", enrich.chunk_metadata(F.col("text"), F.col("source"), F.col("lang")).alias("m")).select("doc_id", "m.*")


@register("chunk_statistics", f"SELECT count(*) AS n_chunks, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(length(text)), 6) AS avg_chars, sum(length(text))::BIGINT AS total_chars FROM (SELECT text, len({sql_words('text')}) AS n FROM documents)", longs=("min_tokens", "max_tokens",))
def chunk_statistics(spark, d):
    out = enrich.chunk_statistics(table(spark, d, "documents").select("text", word_count(F.col("text")).alias("token_count")))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_tokens", "avg_chars")})


@register("section_histogram", "SELECT substr(coalesce(source, '?'), 1, 40) AS section, count(*) AS n_chunks FROM documents GROUP BY 1")
def section_histogram(spark, d):
    return enrich.section_histogram(table(spark, d, "documents").withColumnRenamed("source", "section"))


@register("corpus_union", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def corpus_union(spark, d):
    return enrich.union_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


_REF_TEXT = f"('Referensi: ' || left(text, 30) || ' (2020)' || {NL} || 'Penulis: A, B' || {NL} || 'Kategori: k' || (item_id % 3) || {NL} || 'Ringkasan: ' || text || {NL} || 'Poin Kunci:' || {NL} || '- p' || {NL} || '- q')"


@register("reference_chunks", f"SELECT 'ref_' || CASE WHEN length(item_id::VARCHAR) < 6 THEN lpad(item_id::VARCHAR, 6, '0') ELSE item_id::VARCHAR END AS chunk_id, {sql_strip(_REF_TEXT)} AS text, 'Referensi Ilmiah - k' || (item_id % 3) AS section, 'k' || (item_id % 3) AS subsection, 'stunting_references.json' AS source_file, 0 AS char_start, length({_REF_TEXT}) AS char_end, len({sql_words(_REF_TEXT)}) AS token_count, 't1,t2' AS keywords, item_id::VARCHAR AS ref_id FROM benchmark", longs=("char_end", "token_count",))
def reference_chunks(spark, d):
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.left("text", F.lit(30)).alias("judul"), F.lit("2020").alias("tahun"), F.array(F.lit("A"), F.lit("B")).alias("penulis"), F.concat(F.lit("k"), F.col("item_id") % 3).alias("kategori"), F.col("text").alias("ringkasan"), F.array(F.lit("p"), F.lit("q")).alias("poin_kunci"), F.array(F.lit("t1"), F.lit("t2")).alias("relevansi_topik"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    return enrich.reference_chunks(refs).withColumn("ref_id", F.col("metadata.ref_id")).withColumn("keywords", F.array_join("keywords", ",")).drop("metadata")


@register("embed_text_build", "SELECT doc_id, trim(trim(coalesce(source, '') || ' ' || coalesce(lang, '')) || ' ' || text) AS embed_text FROM documents")
def embed_text_build(spark, d):
    return table(spark, d, "documents").select("doc_id", embed_text(F.col("source"), F.col("lang"), F.col("text")).alias("embed_text"))


@register("postings", "SELECT unnest(string_split(lower(text), ' ')) AS term, doc_id FROM documents")
def all_postings(spark, d):
    return postings.postings(table(spark, d, "documents"))


@register("sorted_postings", "SELECT unnest(string_split(lower(text), ' ')) AS term, doc_id FROM documents ORDER BY term, doc_id")
def sorted_postings(spark, d):
    return postings.sorted_postings(table(spark, d, "documents"))


@register("inverted_index", "SELECT term, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM (SELECT unnest(string_split(lower(text), ' ')) AS term, doc_id FROM documents) GROUP BY term")
def inverted_index(spark, d):
    return postings.inverted_index(table(spark, d, "documents")).withColumn("doc_ids", F.array_join("doc_ids", ","))


@register("boolean_and", "SELECT DISTINCT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') AND list_contains(string_split(lower(text), ' '), 'und')")
def boolean_and(spark, d):
    return postings.boolean_and(table(spark, d, "documents"), "the", "und")


@register("intersect_postings", "WITH i AS (SELECT term, list(DISTINCT doc_id) AS l FROM (SELECT unnest(string_split(lower(text), ' ')) AS term, doc_id FROM documents) GROUP BY term) SELECT array_to_string(list_sort(list_intersect(a.l, b.l)), ',') AS both FROM i a, i b WHERE a.term = 'of' AND b.term = 'the'")
def intersect_postings(spark, d):
    index = postings.inverted_index(table(spark, d, "documents"))
    pair = index.filter(F.col("term").isin("of", "the")).agg(F.max(F.when(F.col("term") == "of", F.col("doc_ids"))).alias("a"), F.max(F.when(F.col("term") == "the", F.col("doc_ids"))).alias("b"))
    return pair.select(F.array_join(postings.intersect(F.col("a"), F.col("b")), ",").alias("both"))


@register("list_documents", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no FROM documents")
def list_documents(spark, d):
    return postings.list_documents(table(spark, d, "documents").select("doc_id"))


@register("append_documents", "SELECT doc_id, text FROM documents UNION ALL SELECT item_id, lower(text) FROM benchmark")
def append_documents(spark, d):
    return postings.add_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
