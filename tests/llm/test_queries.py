"""Registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lakecheck.llm.queries import ORACLES, QUERIES
from lakecheck.llm.storage import written
from tests.llm.data import SCHEMA, ordered, table
from tests.llm.test_arrays import near
from tests.oracle import duck, plain, sorted_rows

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    result = duck(SF).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, result.fetchall())
    assert plain(1) == "1"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_per_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(kind != "void" for _, kind in df.dtypes)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (stays, without_lines, one_of_each, mixed, tokens)):
        after = written(stage(spark, before, SF), "stage")
        check(before, after)
        if name != "pieces":
            assert after.columns == docs.columns
        before = after
    assert ordered(map(tuple, before.select("doc_id", "n_tokens").collect())) == ordered(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()))


def stays(before, after):
    letters = before.where(F.col("text").rlike(r"\p{L}"))
    assert after.count() >= 0.99 * letters.count() and after.select("doc_id").subtract(letters.select("doc_id")).count() == 0


def without_lines(before, after):
    pages, seen = Counter(), Counter()
    data = before.collect()
    for r in data:
        pages[r["source"]] += 1
        seen.update((r["source"], x) for x in {x.strip(" \t\n\x0b\x0c\r") for x in r["text"].split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= 5 and n > 0.05 * pages[k[0]]}
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" \t\n\x0b\x0c\r")) not in gone) for r in data}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert after.where("n_chars <> length(text)").count() == 0


def one_of_each(before, after):
    kept = {i for i, _, _, k in near([(r["doc_id"], r["text"]) for r in before.collect()]) if k}
    assert {r["doc_id"] for r in after.collect()} == kept


def mixed(before, after):
    size = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    have, got = size(before), size(after)
    assert all(got.get(s, 0) <= 3.05 * n for s, n in have.items())
    assert abs(sum(got.values()) - sum(have.values())) < 0.2 * sum(have.values())
    assert after.join(before, "doc_id", "left_anti").count() == 0


def tokens(before, after):
    assert after.count() == before.count()
    assert after.where("n_tokens <> size(tokens)").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    odd = table(spark).select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars"), "node", "bucket")
    for df in (odd, spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, df, SF), "stage")
            if name != "pieces":
                assert out.columns == df.columns
                df = out


def test_pipeline_keeps_a_text_with_many_copies(spark):
    copied = "\n".join(f"content line {k} of the text with copies" for k in range(6))
    data = [(i, f"{copied} \n\n" if i % 2 else copied) for i in range(30)]
    data += [(i, f"Shared header\nown line {i} with words\nanother one {i} of the page") for i in range(30, 90)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    after = written(corpus_pipeline.lines(spark, docs, SF), "stage")
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t.replace("Shared header\n", "") for i, t in data}
    left = corpus_pipeline.near_duplicates(spark, after, SF)
    assert [r["text"] for r in left.collect() if "content" in r["text"]] == [copied]


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b, c = ("one two three four five six seven", "quite another text with words of its own", "and a third one that is held by nobody else")
    data = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (None, c, "s"), (None, c, "s"), (None, c.upper(), "s"), (None, a, "s")]
    data += [(4, "", "s"), (4, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert ordered((r[0], (r[1] or "").lower()) for r in got.collect()) == ordered([(1, a), (2, b), (None, c), (4, ""), (4, ""), (None, "")])
    unique = spark.createDataFrame([r for r in data if r[0] == 3], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, unique, SF).count() == 1


def test_pipeline_drops_languages_that_were_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = [
        "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli jota puhuvat pääosin suomalaiset",
        "xqzjk wvqxz zzkqj pqwxv kjzqx vwqpz xkqjz qqzvx jxwkq zvxqp kwjqz wvqxz zzkqj pqwxv kjzqx vwqpz xkqjz qqzvx",
        "Ez egy magyar nyelvű szöveg amelyet nem tanult meg a modell soha és amely ezért nem maradhat a gyűjteményben",
    ]
    more = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    before = docs.unionByName(more)
    after = corpus_pipeline.language(spark, before, SF)
    assert after.columns == docs.columns
    ids = {r["doc_id"] for r in after.collect()}
    assert not ids & {-1, -2, -3}
    assert ids == {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
