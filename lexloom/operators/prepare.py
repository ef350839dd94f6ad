"""The preparation sheet of a document: what to check, whom to ask what, what is not stated, what to bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.patterns import matches
from ..functions.rows import once
from . import responder, rules
from .catalog import RISKS, RULES

#: (field, heading), in the order of the sheet.
SECTIONS = (("checklist", "Before you sign"), ("for_hr", "Questions for HR"), ("for_lawyer", "Questions for a lawyer"), ("missing", "Not stated"), ("documents", "Documents to bring"))
TITLE, FOOTER, FLAGGED = "Preparation sheet", "Not legal advice.", "Clauses to raise"
NOT_STATED = ": not stated in this document"


def letters(text: Column) -> Column:
    """What tells lines apart: letters, marks and digits, without case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]", "")


def dedupe(lines: Column) -> Column:
    """Trimmed lines that hold something, each once: the first spelling stays."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(kept, letters)
    return F.filter(kept, lambda x, i: F.array_position(keys, letters(x)) == i + 1)


def sheet(clauses: DataFrame, most: int = LIMITS.reviewed_questions) -> DataFrame:
    """(doc_id, the lists of ``SECTIONS``, flagged): one aggregation over clauses with their category.

    The reviewed questions of serious hits, at most ``most``, come behind the responder's own questions for a lawyer.
    flagged: array<struct<label, title, severity, text>> of HIGH hits.
    """
    facts = rules.with_facts(clauses)
    own = F.struct(*[F.coalesce(matches(F.col("text"), has, True), F.lit(False)).alias(f"s{k}") for k, (has, *_) in enumerate(responder.SUGGESTIONS)])
    hits = F.transform(rules.hits_of(F.col("category"), F.col("norm"), F.col("notice"), F.col("amount")), lambda h: F.struct((-rules.risk_of(h["severity"])).alias("r"), F.col("clause_id"), h["rule_id"].alias("rule_id"), h["severity"].alias("severity"), F.coalesce("label", "clause_id").alias("label"), F.col("text")))
    rows = once(facts, hits=hits, states=rules.states(F.col("norm"), F.col("notice")), own=own)
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), *rules.stated(F.col("states")), *[F.bool_or(F.col("own")[f"s{k}"]).alias(f"s{k}") for k in range(len(responder.SUGGESTIONS))])
    asked = F.create_map(*[x for r in RULES for x in (F.lit(r.id), F.array(*[F.lit(q) for q in r.questions]).cast("array<string>"))])
    titles = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.title)])
    reviewed = F.slice(F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: h["r"] <= -RISKS["MEDIUM"]), lambda h: asked[h["rule_id"]]))), 1, most)
    said = {name: F.array_compact(F.array(*[F.when(F.col(f"s{k}"), F.lit(texts[i])) for k, (_, *texts) in enumerate(responder.SUGGESTIONS) if texts[i]])) for i, name in enumerate(responder.LISTS)}
    missing = F.transform(rules.missing(), lambda g: F.concat(g["label"], F.lit(NOT_STATED)))
    flagged = F.transform(F.filter("hits", lambda h: h["severity"] == "HIGH"), lambda h: F.struct(h["label"], titles[h["rule_id"]].alias("title"), h["severity"], h["text"]))
    lists = said | {"for_lawyer": F.concat(said["for_lawyer"], reviewed), "missing": F.array_sort(missing)}
    return docs.select("doc_id", *[dedupe(lists[name]).alias(name) for name, _ in SECTIONS], flagged.alias("flagged"))


def markdown(name: Column) -> Column:
    """The sheet as a file, from the columns of ``sheet``: sections with something in them, then the flagged clauses, quoted."""
    parts = [F.array(F.lit(f"# {TITLE}"), F.lit("")), F.when(name.isNotNull(), F.array(name, F.lit(""))).otherwise(F.array())]
    for field, heading in SECTIONS:
        items = F.transform(field, lambda x: F.concat(F.lit("- [ ] "), x))
        parts.append(F.when(F.size(field) > 0, F.concat(F.array(F.lit(f"## {heading}"), F.lit("")), items, F.array(F.lit("")))).otherwise(F.array()))
    raised = F.flatten(F.transform("flagged", lambda c: F.array(F.concat(F.lit("### "), c["label"], F.lit(" — "), c["title"], F.lit(" ("), c["severity"], F.lit(")")), F.lit(""), F.concat(F.lit("> "), F.replace(c["text"], F.lit("\n"), F.lit("\n> "))), F.lit(""))))
    parts.append(F.when(F.size("flagged") > 0, F.concat(F.array(F.lit(f"## {FLAGGED}"), F.lit("")), raised)).otherwise(F.array()))
    return F.array_join(F.concat(*[p.cast("array<string>") for p in parts], F.array(F.lit("---"), F.lit(""), F.lit(FOOTER))), "\n")
