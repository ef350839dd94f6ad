"""Running the rule library: one projection per clause, no join between clauses and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.patterns import matches
from ..functions.rows import once
from ..functions.text import normalize
from .catalog import GAPS, NO_KEEPING, RISKS, RULES, SALARY_PARTS, TIME_LIMIT, Rule


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def employee_notice(notice: Column) -> Column:
    return F.coalesce(notice["employee"], notice["unattributed"])


def _hit(rule: Rule, category: Column, norm: Column, notice: Column, amount: Column) -> Column:
    """struct<rule_id, severity, amount, yours, theirs, period>, or null where the rule does not fire."""
    gate = category.isin(*rule.applies) if rule.applies else F.lit(True)
    fires = [gate, *(matches(norm, p) for p in rule.has), *(~matches(norm, p) for p in rule.lacks)]
    severity, text = F.lit(rule.severity), F.lit(None).cast("string")
    found = {"amount": text, "yours": text, "theirs": text, "period": text}
    if rule.special == "bond":
        severity = F.when(amount > 0, "HIGH").otherwise("MEDIUM")
        found["amount"] = F.when(amount > 0, extract.format_inr(amount))
    elif rule.special == "asymmetric":
        fires.append(notice["employee"]["days"] > notice["employer"]["days"])
        found |= {"yours": notice["employee"]["text"], "theirs": notice["employer"]["text"]}
    elif rule.special == "long":
        own = employee_notice(notice)
        fires.append(own["days"] >= 60)
        severity = F.when(own["days"] >= 90, "HIGH").otherwise("MEDIUM")
        found["period"] = own["text"]
    elif rule.special == "salary":
        fires.append(salary_parts(norm) >= 2)
    elif rule.special == "keeping":
        fires.append(~matches(norm, rf"{NO_KEEPING}(?![^.]*{TIME_LIMIT})"))
    struct = F.struct(F.lit(rule.id).alias("rule_id"), severity.alias("severity"), *(v.alias(k) for k, v in found.items()))
    return F.when(_all(fires), struct)


def salary_parts(norm: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(matches(norm, p).cast("int"), F.lit(0)) for p in SALARY_PARTS])


def notice_of(norm: Column) -> Column:
    """Notice periods; null for the many texts that do not speak of notice."""
    return F.when(F.contains(norm, F.lit("notice")), extract.notice(norm))


def with_facts(clauses: DataFrame) -> DataFrame:
    """Normalised text, notice and the largest amount, each computed once per clause."""
    return with_periods(once(clauses, norm=normalize(F.col("text"))))


def with_periods(facts: DataFrame) -> DataFrame:
    """Notice and the largest amount of rows with their normalised text."""
    return once(facts, notice=notice_of(F.col("norm")), amount=F.array_max(F.transform(extract.amounts(F.col("norm")), lambda a: a["rupees"])))


def hits_of(category: Column, norm: Column, notice: Column, amount: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<rule_id, severity, amount, yours, theirs, period>>: the rules that fire on a clause."""
    return F.array_compact(tried(category, norm, notice, amount, rules))


def tried(category: Column, norm: Column, notice: Column, amount: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``hits_of`` with null for each rule that does not fire."""
    return F.array(*[_hit(r, category, norm, notice, amount) for r in rules])


def risk_of(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])[severity]


def run_rules(clauses: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, clause_id, rule_id, severity, risk, amount, yours, theirs, period) for clauses with a category, and the
    columns of the clauses that ``keep`` names."""
    # Predicates are regular expressions over one text: one pass, no join of clauses with rules.
    # The rules are tried before any function on arrays: inside one, all of them would be interpreted.
    facts = once(with_facts(clauses), hits=tried(F.col("category"), F.col("norm"), F.col("notice"), F.col("amount"), rules))
    facts = once(facts, hits=F.array_compact("hits"))
    fired = facts.select("doc_id", "clause_id", *keep, F.explode("hits").alias("hit")).select("doc_id", "clause_id", *keep, "hit.*")
    return fired.withColumn("risk", risk_of(F.col("severity")))


def states(norm: Column, notice: Column) -> Column:
    """struct by gap: whether a clause states what it asks for."""
    known = notice["employee"].isNotNull() | notice["employer"].isNotNull() | notice["unattributed"].isNotNull()
    return F.struct(*[(matches(norm, g.pattern) | (known if g.id.endswith("NOTICE") else F.lit(False))).alias(g.id) for g in GAPS])


def stated(states: Column) -> list[Column]:
    """Per gap, whether a clause of the document states what it asks for: aggregates over what ``states`` gives."""
    return [F.coalesce(F.bool_or(states[g.id]), F.lit(False)).alias(g.id) for g in GAPS]


def missing() -> Column:
    """array<struct<gap_id, label, question>> from the columns of ``stated``."""
    return F.array_compact(F.array(*[F.when(~F.col(f"`{g.id}`"), F.struct(F.lit(g.id).alias("gap_id"), F.lit(g.label).alias("label"), F.lit(g.question).alias("question"))) for g in GAPS]))


def find_gaps(clauses: DataFrame) -> DataFrame:
    """(doc_id, gap_id, label, question) for what no clause of a document states; one aggregation per document."""
    facts = once(once(clauses, norm=normalize(F.col("text"))), notice=notice_of(F.col("norm")))
    present = once(facts.select("doc_id", "norm", "notice"), states=states(F.col("norm"), F.col("notice"))).groupBy("doc_id").agg(*stated(F.col("states")))
    return present.select("doc_id", F.explode(missing()).alias("gap")).select("doc_id", "gap.*")
