"""Answers as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.clean import strip

#: Mark of the list of sources, and how long a source's label may be.
REFERENCES, LABEL, SHORT = "📚\\s*Referensi", 55, 52


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inline_markup(text: Column) -> Column:
    """Escaped text with bold, emphasis, code and source tags."""
    text = F.regexp_replace(escape(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<em>$1</em>")
    text = F.regexp_replace(text, "`([^`]+)`", "<code>$1</code>")
    tag = r"→?\s*\(Sumber:\s*([^)]+)\)"
    shown = lambda s: F.when(F.length(s) > LABEL, F.concat(F.substring(s, 1, SHORT), F.lit("…"))).otherwise(s)
    pieces = F.zip_with(F.split(text, tag, -1), F.regexp_extract_all(text, F.lit(tag), F.lit(1)), lambda gap, s: F.concat(gap, F.when(s.isNull(), "").otherwise(F.concat(F.lit('<span class="src-tag" title="'), s, F.lit('">Sumber: '), shown(s), F.lit("</span>")))))
    return F.array_join(pieces, "")


def reference_entries(text: Column) -> Column:
    """Lines of the list of sources behind an answer, without its heading."""
    block = F.regexp_extract(text, f"(?is)({REFERENCES}.*)\\z", 1)
    return F.filter(F.transform(F.split(block, "\n"), strip), lambda s: (s != "") & ~s.rlike(f"(?i){REFERENCES}"))


def answer_body(text: Column) -> Column:
    return F.when(text.rlike(f"(?i){REFERENCES}"), F.regexp_replace(text, f"(?isU)\\s*{REFERENCES}.*\\z", "")).otherwise(text)


def line_kind(line: Column, following: Column) -> Column:
    """heading, ordered, bullet, gap or text, by the first rule that fits."""
    return (
        F.when(line.rlike(r"^#{1,3}\s"), "heading")
        .when(line.rlike(r"^\d+\.\s+\S.{0,80}$") & ~F.coalesce(following, F.lit("")).rlike(r"^\s*[*\-\d]"), "heading")
        .when(line.rlike(r"^\d+\.\s"), "ordered")
        .when(line.rlike(r"^\s*[*\-]\s"), "bullet")
        .when(strip(line) == "", "gap")
        .otherwise("text")
    )


def blocks(texts: DataFrame, keys: list[str], text_col: str = "text", *, strip_marks: bool = True) -> DataFrame:
    """(keys, block, kind, html): lines in runs of list items, other lines alone.

    ``strip_marks=False`` leaves list and heading marks in place."""
    rows = texts.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumn("kind", line_kind(F.col("line"), F.lead("line").over(order)))
    # A run of numbered lines is one list; its last may look like a heading, but is an item of it.
    before = F.lag("kind").over(order)
    rows = rows.withColumn("kind", F.when((F.col("kind") == "heading") & F.col("line").rlike(r"^\d+\.\s") & (before == "ordered"), "ordered").otherwise(F.col("kind")))
    starts = F.when((F.col("kind").isin("ordered", "bullet")) & (F.lag("kind").over(order) == F.col("kind")), 0).otherwise(1)
    rows = rows.withColumn("block", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mark = {"heading": r"^(#+\s*|\d+\.\s+)", "ordered": r"^\d+\.\s+", "bullet": r"^\s*[*\-]\s+"}
    bare = F.col("line")
    if strip_marks:
        for kind, pattern in mark.items():
            bare = F.when(F.col("kind") == kind, F.regexp_replace("line", pattern, "")).otherwise(bare)
    inner = inline_markup(bare)
    indent = F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", ""))
    item = F.when((F.col("kind") == "bullet") & (indent >= 2), F.concat(F.lit('<li class="sub">'), inner, F.lit("</li>"))).otherwise(F.concat(F.lit("<li>"), inner, F.lit("</li>")))
    html = F.when(F.col("kind") == "heading", F.concat(F.lit('<span class="bh">'), inner, F.lit("</span>"))).when(F.col("kind").isin("ordered", "bullet"), item).when(F.col("kind") == "gap", '<span class="bg"></span>').otherwise(F.concat(F.lit('<span class="bp">'), inner, F.lit("</span>")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "html"))), lambda s: s["html"]), "")
    out = rows.withColumn("html", html).groupBy(*keys, "block", "kind").agg(joined.alias("html"))
    wrapped = F.when(F.col("kind") == "ordered", F.concat(F.lit('<ol class="bol">'), F.col("html"), F.lit("</ol>"))).when(F.col("kind") == "bullet", F.concat(F.lit('<ul class="bul">'), F.col("html"), F.lit("</ul>"))).otherwise(F.col("html"))
    return out.withColumn("html", wrapped)


def render(texts: DataFrame, keys: list[str], text_col: str = "text", *, strip_marks: bool = True) -> DataFrame:
    """(keys, html): the blocks of each answer, then its list of sources."""
    body = blocks(texts.withColumn(text_col, answer_body(F.col(text_col))), keys, text_col, strip_marks=strip_marks)
    html = body.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "html"))), lambda s: s["html"]), "").alias("html"))
    entries = F.transform(reference_entries(F.col(text_col)), lambda s: F.concat(F.lit('<div class="ref-entry">'), inline_markup(F.regexp_replace(s, r"^[*\-\d.]\s*", "") if strip_marks else s), F.lit("</div>")))
    refs = texts.select(*keys, entries.alias("e")).select(*keys, F.when(F.size("e") > 0, F.concat(F.lit('<div class="ref-block"><div class="ref-head">Referensi</div>'), F.array_join("e", ""), F.lit("</div>"))).otherwise("").alias("refs"))
    return html.join(refs, keys).select(*keys, F.concat("html", "refs").alias("html"))
