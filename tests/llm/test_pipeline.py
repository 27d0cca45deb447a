import re

import corpus_pipeline as cp
from plumbline.llm import decontam
from pyspark.sql import functions as F
from test_mixing import slow_taken
from tests_llm_helpers import dup_lines, near_groups

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in cp.run(spark, DATA).collect()}
    # language: every text with a letter is in a language that others of the table teach
    rows = [r for r in rows if r[1] and re.search("[A-Za-z]", r[1])]
    # lines
    gone = dup_lines([(r[0], r[1]) for r in rows])
    kept = []
    for r in rows:
        lines = r[1].split("\n")
        left = [s for i, s in enumerate(lines) if (r[0], i) not in gone]
        if len(left) == len(lines) or "".join(left).strip():
            kept.append((r[0], "\n".join(left), *r[2:]))
    # near duplicates
    root = near_groups([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if root[r[0]] == r[0]]
    # benchmark passages, whole
    items = [b.text for b in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0]: r for r in kept if not any(b in r[1] for b in items)}
    # the mix, word by word
    taken = {i: n for i, n in slow_taken(spark, [(r[0], r[1], r[3]) for r in clean.values()]) if n}
    assert {i: r.taken for i, r in got.items()} == taken and len(taken) > 50
    assert all(got[i].text == clean[i][1] and got[i].source == clean[i][3] and got[i].lang == clean[i][2] for i in got)


def test_the_mix_carries_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 9.5, "x")], "doc_id long, text string, source string, size long, more double, `odd name` string")
    out = cp.mix(spark, docs, DATA)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "text", "source", "size_given", "more", "odd name"]
    assert tuple(out.first())[:5] == (1, 3, 3, 3.0, 3)


def test_repeated_rows_and_ties(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.union(docs.limit(30)).withColumn("c0", F.lit("own"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, twice, DATA)
        assert out.columns == twice.columns, name
        n, most = out.count(), twice.count()
        assert 0 < n <= most, name


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"] and cp.ORACLE_SQL is None


def test_stages_on_an_empty_table_and_nulls(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    none = docs.limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "the thing", "en", None, 3), (2, "", "en", "s", 0)], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, none, DATA).count() == 0
        stage(spark, odd, DATA).count()
    assert decontam.drop_leaking(odd, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 3
