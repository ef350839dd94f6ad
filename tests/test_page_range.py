"""The pages of a document's clauses, from its blocks."""

from lexloom.operators import segment as S
from pyspark.sql import functions as F


def test_pages_of_blocks_are_those_of_clauses(spark):
    """Titles and furniture have no page of their own; fragments, long texts and more clauses than are kept do not matter."""
    rows = [(1, 0, "PAY AND LEAVE", 1), (1, 1, "1.1 " + "You are paid each month. " * 400, 2), (1, 2, "and any renewal thereof.", 3), (1, 3, "page 9", 9), (2, 0, "----------", 4), (3, 0, "Regards", None)]
    rows += [(4, k, f"{k + 1}. You shall keep this.", k) for k in range(500)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string, page int")
    got = {r["doc_id"]: (r["page"], r["page_end"]) for r in S.page_range(lines).collect()}
    clauses = S.segment(lines, most=1000).groupBy("doc_id").agg(F.min("page").alias("page"), F.max("page_end").alias("page_end"))
    assert got == {r["doc_id"]: (r["page"], r["page_end"]) for r in clauses.collect()} == {1: (2, 3), 3: (None, None), 4: (0, 499)}


def test_no_text_is_merged_or_cut(spark):
    plan = S.page_range(spark.createDataFrame([(1, 0, "a", 1)], "doc_id long, line_no int, text string, page int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "island" not in plan
