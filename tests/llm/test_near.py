"""Near duplicates where ids are repeated, in clusters larger than a block."""

from lakecheck.llm.setsketch import BLOCK, near_groups, near_unique


def cluster(n):
    base = [f"word{k}" for k in range(80)]
    return base, [" ".join([*base[:-1], f"last{i}"]) for i in range(n)]


def test_an_id_with_two_texts_lends_its_class_no_other_text(spark):
    base, copies = cluster(BLOCK + 60)
    # like its neighbours to the eye, yet under the threshold; and a copy of a member under the same id
    unlike = " ".join([*base[:64], *(f"other{k}" for k in range(16))])
    rows = [(10 + i, t) for i, t in enumerate(copies)] + [(5, unlike), (5, copies[0]), (5, copies[7])]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(r["component_id"] for r in got) == [5] * len(rows)
    alone = [(100_000, unlike)] + rows[:-3]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(alone, "doc_id long, text string")).collect()}
    assert got[100_000] == 100_000 and set(got.values()) == {10, 100_000}
    mixed = near_unique(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r["text"] == unlike for r in mixed) == [False, True]


def test_rows_without_an_id_do_not_meet_all_others_without_one(spark):
    _, copies = cluster(40)
    apart = [" ".join(f"own{i}x{k}" for k in range(12)) for i in range(30)]
    rows = [(None, t) for t in copies + apart + copies]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near_unique(df).count() == 31
    assert {r["component_id"] for r in near_groups(df).collect()} == {None}
