"""Plans whose cost must not grow faster than the tables: exchanges, joins, sorts and what is interpreted."""

import pytest
from lexloom.functions.rows import once
from lexloom.operators.segment import fold_sections
from lexloom.plans import contracts, q_compare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def plan(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_function_on_arrays_stays_out_of_the_generator(spark, plan):
    made = once(spark.range(3), x=F.transform(F.array("id"), lambda v: v + 1))
    assert not [line for line in plan(made).splitlines() if "Generate" in line and "lambda" in line]
    assert [r.x for r in made.orderBy("id").collect()] == [[1], [2], [3]]


def test_clauses_of_one_place_meet_without_a_join(spark, plan):
    said = plan(q_compare.set_jaccard(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["sort_pairs", "pp_changes", "win_greedy"])
def test_pairs_are_dealt_by_document_only(spark, plan, name):
    # Once for the clauses of each side, and once behind the Python step of normalisation.
    said = plan(getattr(q_compare, name)(spark, SF))
    assert "MapInArrow" not in said and said.count("Exchange hashpartitioning") + said.count("ReusedExchange") <= 4


def test_versions_without_a_clause_are_paired(spark):
    from lexloom.operators import pairing

    kind = "doc_id long, clause_id string, ord int, label string, text string"
    a = spark.createDataFrame([(1, "c001", 1, None, "Salary is paid monthly"), (2, "c001", 1, "1.1", "Only here")], kind)
    b = spark.createDataFrame([(1, "c001", 1, None, "Salary is paid monthly"), (3, "c001", 1, None, "New text"), (1, "c002", 2, None, "Another matter entirely")], kind)
    rows = {(r.doc_id, r.a_ord, r.b_ord, r.pair_id, r.identical, r.place) for r in pairing.placed(pairing.paired_documents(a, b)).collect()}
    assert rows == {(1, 1, 1, "c001-c001", True, 1), (1, None, 2, "none-c002", False, 2), (2, 1, None, "c001-none", False, 1), (3, None, 1, "none-c001", False, 1)}


def test_long_tables_get_more_tasks(spark, monkeypatch):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = spark.range(1000).select(F.col("id").alias("l_orderkey"))
    assert contracts.by_order(items) is items
    monkeypatch.setattr(contracts, "TASK_ROWS", 1000 // (4 * few))
    assert contracts.by_order(items).rdd.getNumPartitions() >= 4 * few


def test_sections_are_folded_over_one_order(spark, plan):
    kind = "doc_id long, block long, label string, heading string, text string, n_lines int, page int, page_end int"
    blocks = [(1, 1, None, None, "Before", 1, 1, 1), (1, 2, "1", None, "1. PAY", 1, 1, 1), (1, 3, "1.1", None, "1.1 Paid", 2, 1, 1), (1, 4, "2.1", None, "2.1 Other", 2, 1, 1), (1, 5, "1.2", None, "1.2 Late", 2, 1, 1)]
    found = fold_sections(spark.createDataFrame(blocks, kind))
    assert plan(found).count("Sort [") == 1
    assert {(r.block, r.heading) for r in found.collect()} == {(1, None), (3, "Pay"), (4, None), (5, None)}
