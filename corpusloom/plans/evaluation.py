"""The whole evaluation of an index as one table, as lines, and as a command."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frozen import frozen
from corpusloom.operators import metrics, ranking
from corpusloom.sources import corpus

PARTS = ("intrinsic", "coherence", "section_coherence", "geometry", "duplicates", "retrieval", "retrieval_per_query", "coverage", "coverage_sections", "scorecard", "recommendations")
#: Cosine from which two vectors are duplicates, and the depths of the ranking metrics.
DUPLICATE, DEPTHS = 0.95, (1, 3, 5)
COLUMNS = "part string, item string, metric string, value double, note string"


def tidy(df: DataFrame, part: str, columns: Sequence[str], item: str | None = None) -> DataFrame:
    """(part, item, metric, value, note): a row for each of these columns of each row."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    name = F.coalesce(F.col(item).cast("string"), F.lit("?")) if item else F.lit("")
    return df.select(F.lit(part).alias("part"), name.alias("item"), F.inline(F.array(*cells))).withColumn("note", F.lit(""))


def evaluate(vectors: DataFrame, items: DataFrame, queries: DataFrame, relevant: DataFrame, *, id_col: str = "chunk_id", parts: Sequence[str] = PARTS, duplicate: float = DUPLICATE) -> DataFrame:
    """The report as rows (part, item, metric, value, note).

    ``vectors`` has id_col, embedding and section; ``items`` item_id (integral), text,
    keywords and section; ``queries`` query_id and query; ``relevant`` query_id, sections
    and ids (arrays of what answers it). Only the parts asked for are computed, and each of
    them once: what several parts show is written and read again. Without vectors or
    items a part has what its operator gives then."""
    spark = vectors.sparkSession
    found = [spark.createDataFrame([], COLUMNS)]
    embedding = {"vector_col": "embedding", "section_col": "section"}
    want = set(parts)
    shown = want & {"scorecard", "recommendations"}
    once = lambda df: frozen(df) if shown or len(want) > 1 else df
    intrinsic = metrics.norm_stats(vectors).withColumn("is_normalized", F.col("is_normalized").cast("int"))
    elements = metrics.element_stats(vectors).withColumnsRenamed({c: f"element_{c}" for c in ("mean", "std", "min", "max")})
    tokens = metrics.token_stats(items)
    if want & {"intrinsic", "coherence", "duplicates"} or shown:
        pairs = once(metrics.pair_extremes(vectors, id_col=id_col, near=duplicate))
    if "intrinsic" in want or shown:
        norms, loss = once(tidy(intrinsic, "intrinsic", intrinsic.columns)), tidy(pairs, "intrinsic", ["uniformity_loss"])
        words = once(tidy(tokens, "intrinsic", tokens.columns))
    if "intrinsic" in want:
        found += [norms, tidy(elements, "intrinsic", elements.columns), loss, words]
    if "coherence" in want or shown:
        alike = metrics.coherence(vectors, **embedding)
        alike = once(tidy(alike, "coherence", alike.columns))
    if "coherence" in want:
        found += [alike, tidy(pairs, "coherence", ["cosine_max"])]
    if "section_coherence" in want:
        found.append(tidy(metrics.section_coherence(vectors, **embedding), "section_coherence", ["n_chunks", "avg_sim", "std_sim"], "section"))
    if "geometry" in want:
        shape = metrics.pca_geometry(vectors).withColumns({f"variance_{k + 1}": F.get("top5", F.lit(k)) for k in range(5)}).drop("top5")
        found.append(tidy(shape, "geometry", shape.columns))
    if "duplicates" in want or shown:
        near = tidy(pairs.withColumnRenamed("n_near", "n_duplicates"), "duplicates", ["n_duplicates"])
    if "duplicates" in want:
        found += [near, tidy(pairs, "duplicates", ["n_pairs"])]
    if want & {"retrieval", "retrieval_per_query"} or shown:
        truth = relevant.select("query_id", "sections")
        ranked = ranking.first_ranks(queries, items, truth, k=max(DEPTHS))
        per = metrics.ranking_metrics(ranked, truth.select("query_id", F.size("sections").alias("n_relevant")), DEPTHS)
        hit = metrics.chunk_hit(ranked, relevant.select("query_id", "ids")).select("query_id", F.col("hit").cast("int").alias("chunk_hit@3"))
        per = once(per.join(hit, "query_id", "left"))
        mean = metrics.mean_metrics(per)
        mean = tidy(mean, "retrieval", mean.columns)
    if "retrieval" in want:
        found.append(mean)
    if "retrieval_per_query" in want:
        found.append(tidy(per, "retrieval_per_query", [c for c in per.columns if c != "query_id"], "query_id"))
    if "coverage" in want:
        covered = metrics.coverage(items)
        found.append(tidy(covered, "coverage", covered.columns))
    if "coverage_sections" in want:
        sections = items.groupBy(F.coalesce("section", F.lit("?")).alias("section")).agg(F.count("*").alias("n_chunks"))
        found.append(tidy(sections, "coverage_sections", ["n_chunks"], "section"))
    if shown:
        renamed = {"is_normalized": "Normalisasi L2", "uniformity_loss": "Uniformity Loss", "separation_ratio": "Separation Ratio", "P@3": "Precision@3"}
        rows = norms.union(loss).union(words).union(alike).union(near).union(mean).select("metric", "value")
        named = F.coalesce(F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])[F.col("metric")], F.col("metric"))
        # The loss is the better the lower it is; its limits are those of its negative.
        cards = rows.select(named.alias("metric"), F.when(F.col("metric") == "uniformity_loss", -F.col("value")).otherwise(F.col("value")).alias("value"))
        for part, table, note in (("scorecard", metrics.scorecard(cards), "status"), ("recommendations", metrics.recommendations(rows), "priority")):
            if part in want:
                found.append(table.select(F.lit(part).alias("part"), F.lit("").alias("item"), "metric", "value", F.col(note).alias("note")))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def report_lines(report: DataFrame, digits: int = 4) -> DataFrame:
    """(part, no, line) of a report: under each part its rows, numbered by item and metric."""
    shown = F.when(F.col("value").isNull(), "-").otherwise(F.format_string(f"%.{digits}f", "value"))
    line = F.concat(F.when(F.col("item") != "", F.concat("item", F.lit(" "))).otherwise(""), "metric", F.lit(" = "), shown, F.when(F.col("note") != "", F.concat(F.lit(" ["), "note", F.lit("]"))).otherwise(""))
    return report.select("part", F.expr("row_number() over (partition by part order by item, metric)").cast("long").alias("no"), line.alias("line"))


def report_json(report: DataFrame) -> DataFrame:
    """(part, body): each part as one JSON object, item and metric joined to its keys."""
    name = F.when(F.col("item") != "", F.concat("item", F.lit("/"), "metric")).otherwise(F.col("metric"))
    key = F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")  # a list of one, for its marks
    cell = F.when(F.col("note") != "", F.to_json(F.struct("value", "note"))).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    entries = F.array_sort(F.collect_list(F.concat(key, F.lit(":"), cell)))
    return report.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("body"))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """``python -m corpusloom.plans.evaluation --npz V --meta M --report R [--truth T]``."""
    parser = argparse.ArgumentParser(description="Evaluate an index of chunks.")
    parser.add_argument("--npz", required=True, help="vectors: an .npz file of embeddings and chunk_ids, or a Parquet table")
    parser.add_argument("--meta", required=True, help="chunks: a JSON file with a list chunks, or a Parquet table")
    parser.add_argument("--report", required=True, help="where the report goes, as JSON")
    parser.add_argument("--truth", help="JSON lines of query, relevant_sections and relevant_chunk_ids")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    chunks = (spark.read.parquet(given.meta) if not given.meta.endswith(".json") else corpus.read_chunk_file(spark, given.meta)).select("chunk_id", "text", "section", "keywords")
    vectors = corpus.read_npz(spark, given.npz) if given.npz.endswith(".npz") else corpus.read_vectors(spark, given.npz, precision="double")
    vectors = vectors.join(chunks.select("chunk_id", "section"), "chunk_id", "left")
    asked = spark.read.schema("query string, relevant_sections array<string>, relevant_chunk_ids array<string>").json(given.truth) if given.truth else spark.createDataFrame([], "query string, relevant_sections array<string>, relevant_chunk_ids array<string>")
    asked = asked.select(F.xxhash64("query").alias("query_id"), "query", F.coalesce("relevant_sections", F.array().cast("array<string>")).alias("sections"), F.transform("relevant_chunk_ids", lambda c: F.xxhash64(c)).alias("ids"))
    items = chunks.withColumn("item_id", F.xxhash64("chunk_id"))
    report = evaluate(vectors, items, asked.select("query_id", "query"), asked.select("query_id", "sections", "ids"))
    corpus.write_report(report, given.report)
    for r in report_lines(corpus.read_report(spark, given.report).filter(F.col("item") == "")).orderBy("part", "no").collect():  # one row a metric, whatever the data
        print(f"{r['part']}: {r['line']}")


if __name__ == "__main__":
    main()
