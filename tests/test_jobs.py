"""The jobs: against SQL, over growing input, and run again."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings
from jobs import build_chunks, catalog, update_index
from jobs.settings import settings

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.streaming.schemaInference")}
    ours, theirs = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(theirs.columns))
    assert rows(ours) == sorted(map(str, con.sql(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()))
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_index_of_a_table_that_is_a_folder(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 20")
    table.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.job2_update_index(spark, str(tmp_path))
    assert found.agg(F.sum("n")).first()[0] == postings.index_blocks(table).agg(F.sum(F.size("doc_ids"))).first()[0]


@pytest.fixture(scope="module")
def docs(spark):
    text = "[SEKSI 1] Gizi\nA. Anak\n" + "ibu hamil dan balita sehat " * 60 + "\n\nB. Lain\nASI saja"
    made = [(1, text, "a"), (2, "a plain text of several words, long enough to be one chunk of its own", "a"), (3, None, "b"), (4, "stunting di Kendari pada tahun 2020, dan banyak lagi yang perlu ditulis", None), (5, "", ""), (6, "yet another text of several words that is long enough to be a chunk", "c/d=e")]
    return spark.createDataFrame(made, "doc_id long, text string, source string")


# --- build_chunks


def test_chunks_are_parted_by_source_and_a_rerun_changes_nothing(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    first = build_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    once, counted = rows(build_chunks.read_chunks(spark, f"{tmp_path}/out")), rows(build_chunks.read_statistics(spark, f"{tmp_path}/out"))
    assert first == build_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out") and first["documents"] == 6
    assert rows(build_chunks.read_chunks(spark, f"{tmp_path}/out")) == once and rows(build_chunks.read_statistics(spark, f"{tmp_path}/out")) == counted
    parts = {r["part"] for r in build_chunks.read_chunks(spark, f"{tmp_path}/out").select("part").collect()}
    assert parts == {"a", "none", "c/d=e"}
    tags = {r["doc_id"]: (r["keywords"], r["location"]) for r in build_chunks.read_chunks(spark, f"{tmp_path}/out").collect()}
    assert tags[4][1] == "kendari_sultra" and tags[4][0]


def test_a_run_over_some_sources_leaves_the_others(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    build_chunks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    docs.filter("doc_id = 2").withColumn("text", F.concat("text", F.lit(" and something new"))).write.parquet(f"{tmp_path}/newer")
    assert build_chunks.run(spark, f"{tmp_path}/newer", f"{tmp_path}/out", sources=["a"]) == {"documents": 1, "chunks": 1}
    after = {r["doc_id"]: r["text"] for r in build_chunks.read_chunks(spark, f"{tmp_path}/out").collect()}
    assert sorted(after) == [2, 4, 6] and after[2].endswith("something new")
    assert {r["part"]: r["n_chunks"] for r in build_chunks.read_statistics(spark, f"{tmp_path}/out").collect()} == {"a": 1, "none": 1, "c/d=e": 1}
    build_chunks.run(spark, f"{tmp_path}/newer", f"{tmp_path}/out")
    assert [r["doc_id"] for r in build_chunks.read_chunks(spark, f"{tmp_path}/out").collect()] == [2]


# --- update_index


def index_of(spark, out):
    return {(r["term"], r["block"]): r["doc_ids"] for r in update_index.read_index(spark, out).collect()}


def test_index_takes_only_what_is_new(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first, second = table.filter("doc_id < 80"), table.filter("doc_id >= 80").unionByName(spark.createDataFrame([(None, "no id at all"), (9_000_000, None)], table.schema))
    places = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    first.coalesce(1).write.parquet(places[0])
    assert update_index.run(spark, *places) == {"batches": 1, "documents": first.count()}
    once = index_of(spark, places[1])
    assert update_index.run(spark, *places) == {"batches": 0, "documents": 0} and index_of(spark, places[1]) == once
    second.repartition(3).write.mode("append").parquet(places[0])
    assert update_index.run(spark, *places, files_per_batch=2) == {"batches": 2, "documents": second.count() - 1}
    whole = {(r["term"], r["block"]): r["doc_ids"] for r in postings.index_blocks(table.unionByName(second.filter("doc_id = 9000000"))).filter("term is not null").collect()}
    assert index_of(spark, places[1]) == whole
    assert [(r["batch"], r["n_without_id"]) for r in update_index.read_batches(spark, places[1]).orderBy("batch").collect()][0] == (0, 0)
    assert sum(r["n_without_id"] for r in update_index.read_batches(spark, places[1]).collect()) == 1


def test_a_batch_that_is_replayed_changes_nothing(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for batch, some in enumerate((table.filter("doc_id < 80"), table.filter("doc_id >= 80"))):
        postings.write_index(some, f"{tmp_path}/index", batch=batch)
    once = rows(spark.read.schema(postings.STORED).parquet(f"{tmp_path}/index"))
    postings.write_index(table.filter("doc_id < 80"), f"{tmp_path}/index", batch=0)
    assert rows(spark.read.schema(postings.STORED).parquet(f"{tmp_path}/index")) == once


def test_lookup_reads_the_terms_buckets_alone(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for batch in range(2):
        postings.write_index(table.filter(f"doc_id % 2 = {batch}"), f"{tmp_path}/index", batch=batch, span=16)
    for terms in (["The", "und"], ["of", "the"], ["of"], ["the", "nowhere"], ["of", "the", "and"], ["the", "the"]):
        found = postings.lookup(spark, f"{tmp_path}/index", terms)
        held = F.lit(True)
        for t in terms:
            held = held & F.array_contains(F.split(F.lower("text"), " ", -1), t.lower())
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in table.filter(held).collect()), terms
    plan = found._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "bucket" in line.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in line.replace("EqualTo(term", "In(term")
    with pytest.raises(ValueError, match="no terms"):
        postings.lookup(spark, f"{tmp_path}/index", [])


# --- command lines


def test_settings(tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"documents": "a", "size": 1, "sources": []}))
    assert settings([str(file), "documents=s3a://b/c", "size=7", 'sources=["x"]']) == {"documents": "s3a://b/c", "size": 7, "sources": ["x"]}
    for wrong in ([], [str(file), "nothing=1"], [str(file), "size"]):
        with pytest.raises(SystemExit):
            settings(wrong)
    for job in ("build_chunks", "update_index"):
        assert json.loads((ROOT / f"jobs/{job}.json").read_text())


def test_command_line(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/in")
    args = [f"documents={tmp_path}/in", f"out={tmp_path}/out", f"checkpoint={tmp_path}/checkpoint"]
    done = subprocess.run([sys.executable, "-m", "jobs.update_index", "jobs/update_index.json", *args], cwd=ROOT, capture_output=True, text=True, check=True)
    assert "took 6 documents" in done.stderr
    assert index_of(spark, f"{tmp_path}/out")[("balita", 0)] == [1]
