"""Segmentation of texts into sections, paragraphs, sentences and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import strip
from corpusloom.functions.tokens import let, word_count, words

# The patterns of headings.
SECTION = r"(?isU)\[SEKSI\s+(\d+)\]\s+(.*?)(?=\[SEKSI|\z)"
SUBSECTION = r"(?mdU)^([A-Z]\.\s+.+)$"
#: Names of parts without a heading.
WHOLE, GENERAL, LEAD = "Dokumen Stunting", "Umum", "Pendahuluan"
CUT = "␞"


def sections(text: Column) -> Column:
    """Array of (num, title, body). Text before the first heading is dropped; a body
    begins with its title line; without headings the whole text is section 0."""

    def named(n: Column, raw: Column) -> Column:
        return let(strip(raw), lambda body: F.struct(n.alias("num"), strip(F.substring_index(body, "\n", 1)).alias("title"), body.alias("body")))

    found = F.zip_with(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), F.regexp_extract_all(text, F.lit(SECTION), F.lit(2)), named)
    whole = F.array(F.struct(F.lit("0").alias("num"), F.lit(WHOLE).alias("title"), text.alias("body")))
    return let(found, lambda all_of_them: F.when(F.size(all_of_them) > 0, all_of_them).otherwise(whole))


def subsections(text: Column) -> Column:
    """Array of (label, text): parts under lettered headings, text before them as a
    lead, headings without text dropped; without headings one general part."""

    def parts(marked: Column) -> Column:
        lead = F.array(F.struct(F.lit(LEAD).alias("label"), strip(F.get(marked, F.lit(0))).alias("text")))
        pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(marked) / 2).cast("int")), lambda i: F.struct(strip(F.get(marked, 2 * i - 1)).alias("label"), strip(F.get(marked, 2 * i)).alias("text")))
        kept = F.filter(F.concat(lead, pairs), lambda p: p["text"] != "")
        return F.when(F.size(marked) < 2, F.array(F.struct(F.lit(GENERAL).alias("label"), text.alias("text")))).otherwise(kept)

    return let(F.split(F.regexp_replace(text, SUBSECTION, f"{CUT}$1{CUT}"), CUT), parts)


def paragraphs(text: Column, mark: str = "\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, mark), strip), lambda p: p != "")


def overlap_tail(text: Column, n: int) -> Column:
    """The last ``n`` words joined by spaces, or a text that is no longer as it is."""
    w = words(text)
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, -n, n) if n else F.slice(w, 1, 0), " "))


def chunk_words(parts: Column, *, size: int = 200, overlap: int = 50, least: int = 50, joint: str = "\n\n") -> Column:
    """Greedy chunks over an array of paragraphs, one native fold.

    A paragraph joins the buffer while both hold ``size`` words at most; else the buffer
    is emitted if it has ``least`` characters, and its last ``overlap`` words lead the
    next. What is left at the end is emitted or lost by the same least length. Words are
    counted once a paragraph, as the joint, which is white space, joins none."""
    if joint.strip():
        raise ValueError("paragraphs are joined by white space")

    def step(acc: Column, x: Column) -> Column:
        buffer, n = acc["buffer"], acc["n"]
        joined = F.when(buffer != "", F.concat(buffer, F.lit(joint), x["p"])).otherwise(x["p"])
        led = let(overlap_tail(buffer, overlap), lambda tail: F.when(tail != "", strip(F.concat(tail, F.lit(joint), x["p"]))).otherwise(x["p"]))
        out = F.when(F.length(buffer) >= least, F.concat(acc["out"], F.array(buffer))).otherwise(acc["out"])
        fits = F.struct(joined.alias("buffer"), (n + x["n"]).alias("n"), acc["out"].alias("out"))
        full = F.struct(led.alias("buffer"), (F.least(n, F.lit(overlap)) + x["n"]).alias("n"), out.alias("out"))
        return F.when(n + x["n"] <= size, fits).otherwise(full)

    return F.aggregate(
        F.transform(parts, lambda p: F.struct(p.alias("p"), word_count(p).alias("n"))),
        F.struct(F.lit("").alias("buffer"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.when(F.length(acc["buffer"]) >= least, F.concat(acc["out"], F.array(acc["buffer"]))).otherwise(acc["out"]),
    )


def chunk_chars(text: Column, *, size: int = 600, overlap: int = 120) -> Column:
    """Greedy chunks over lines by characters; the tail of a chunk leads the next."""

    def step(acc: Column, p: Column) -> Column:
        now = acc["now"]
        fits = F.length(now) + F.length(p) < size
        tail = F.when(F.length(now) > overlap, F.right(now, F.lit(overlap)) if overlap else now).otherwise(F.lit(""))
        return F.struct(
            F.when(fits, F.concat(now, p, F.lit(" "))).otherwise(F.concat(tail, p, F.lit(" "))).alias("now"),
            F.when(~fits & (now != ""), F.concat(acc["out"], F.array(strip(now)))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(
        paragraphs(text, "\n"),
        F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.when(acc["now"] != "", F.concat(acc["out"], F.array(strip(acc["now"])))).otherwise(acc["out"]),
    )


def sentences(text: Column) -> Column:
    """Cut at white space between a full stop, ! or ? and a capital."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def chunk_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, size: int = 200, overlap: int = 50, least: int = 50) -> DataFrame:
    """Chunks of sections and subsections, numbered within their document.

    Overlap never crosses a subsection; offsets are those of the first place where a
    chunk's first 50 characters stand in the whole text, or 0. All chunks of a document
    are made, and numbered, in its own row, so nothing is exchanged."""
    source, text = F.col(source_col) if source_col else F.lit(""), F.col(text_col)

    def chunk(heading: Column, label: Column, raw: Column) -> Column:
        start = F.greatest(F.lit(0), F.instr(text, F.substring(raw, 1, 50)) - 1)
        return let(start, lambda at: F.struct(heading.alias("section"), label.alias("subsection"), strip(raw).alias("text"), at.alias("char_start"), (at + F.length(raw)).alias("char_end"), word_count(raw).alias("token_count")))

    def section(s: Column) -> Column:
        heading = F.concat(F.lit("SEKSI "), s["num"], F.lit(": "), s["title"])
        return F.transform(subsections(s["body"]), lambda u: F.transform(chunk_words(paragraphs(u["text"]), size=size, overlap=overlap, least=least), lambda c: chunk(heading, u["label"], c)))

    rows = docs.select(F.col(id_col), source.alias("source_file"), F.posexplode(F.flatten(F.flatten(F.transform(sections(text), section)))).alias("__no", "__c"))
    no = (F.col("__no") + 1).alias("chunk_no")
    number = (F.col("__no") + 1).cast("string")
    chunk_id = F.concat(F.lit("chunk_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("chunk_id")
    return rows.select(id_col, "source_file", *[F.col("__c")[c].alias(c) for c in ("section", "subsection", "text", "char_start", "char_end", "token_count")], no, chunk_id)
