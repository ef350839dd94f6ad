"""The deterministic responder: pattern tables in order, the first that matches wins.

Fixed values: the order, categories, risks and patterns. The wording is this library's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import extracted, matches
from ..functions.rows import let, once
from .catalog import BOND_AMOUNT, BOND_TOPIC, DOCUMENT_TYPE, GLOSSARY, SUMMARY

CLASSES = (
    ("NON_COMPETE", "HIGH", r"non[- ]?comp|competes with|competing business"),
    ("DOCUMENT_RETENTION", "HIGH", r"original (certificate|document|mark ?sheet)"),
    ("BOND_OR_EXIT_PENALTY", "HIGH", r"liquidated damages|minimum period of|service bond|training cost"),
    ("NOTICE_PERIOD", "MEDIUM", r"notice of resignation|written notice|notice period"),
    ("TERMINATION", "MEDIUM", r"terminate your employment|with immediate effect|without notice"),
    ("IP_ASSIGNMENT", "MEDIUM", r"intellectual property|work product|invention"),
    ("COMPENSATION", "INFO", r"cost to company|\bctc\b|basic salary|joining bonus"),
    ("PROBATION", "MEDIUM", r"probation"),
    ("CONFIDENTIALITY", "INFO", r"confidential|trade secret"),
    ("NON_SOLICIT", "MEDIUM", r"solicit|entice away"),
    ("DISPUTE_RESOLUTION", "INFO", r"arbitration|jurisdiction"),
    ("MOONLIGHTING", "INFO", r"whole time and attention|any other employment"),
)
#: (asked, in the clause, status, answer)
TOPICS = (
    (r"competitor|competing|non[- ]?compete|another company|rival", r"competes with|non[- ]?comp", "needs_professional", "A clause restricts joining a competing business; whether it holds is a question for a lawyer."),
    (r"notice period|how much notice|resign|quit|leave the (job|company)", r"notice of resignation|written notice|notice period", "answered", "The quoted clause states the notice of each side."),
    (r"bond|penalty|pay back|liquidated|leave early|minimum service", r"liquidated damages|minimum period of|training cost", "needs_professional", "A clause names an amount for leaving early; what is owed is a question for a lawyer."),
    (r"\bsalary\b|\bctc\b|cost to company|in.?hand|take.?home|compensation|salary breakup|joining bonus", r"cost to company|\bctc\b|basic salary", "answered", "The quoted clause states the pay and its parts."),
    (r"probation|confirm", r"probation", "answered", "The quoted clause states the probation."),
    (r"fired|terminate|dismiss|let me go|sack", r"terminate your employment|without notice|immediate effect", "needs_professional", "A clause says how employment can be ended; ask a lawyer how it applies."),
    (r"document|certificate|mark ?sheet|original", r"original (certificate|document|mark ?sheet)", "answered", "The quoted clause says when originals come back."),
)
#: (pattern, checklist, for HR, for a lawyer, document); None where a topic adds nothing to a list.
SUGGESTIONS = (
    (r"liquidated damages|minimum period of|training cost", "Add up the cost of leaving early.", "Does the bond fall by month?", "Is the bond a fair estimate?", "Any training agreement."),
    (r"competes with|non[- ]?comp", "Check which companies the restriction covers.", None, "Would the restriction hold?", None),
    (r"notice of resignation|notice period", "Have the notice confirmed in writing.", "Can notice be bought out?", None, None),
    (r"original (certificate|document|mark ?sheet)", "Ask for a receipt for originals.", "Are copies enough?", None, "Copies of certificates."),
    (r"cost to company|\bctc\b", "Have the monthly pay confirmed.", "What is paid out each month?", None, "The salary breakup."),
    (r"probation", None, "How long can probation last?", None, None),
)
LISTS = ("checklist", "for_hr", "for_lawyer", "documents")
#: Sentence of the citing responder: no full stop inside, 25 to 180 characters before one.
CITED = r"[^.]{25,180}\."
SENTENCE = r"[A-Z(](?:[^.]|\.(?=\S)|(?<=\b(?:Rs|No|Nos|viz))\.)*?\.(?=\s|\z)"


def classify(text: Column) -> Column:
    """struct<category, risk> of the first pattern that matches, ignoring case; null if none does."""

    def first(low: Column) -> Column:
        return F.coalesce(*[F.when(matches(text, p, True, low), F.struct(F.lit(c).alias("category"), F.lit(r).alias("risk"))) for c, r, p in CLASSES])

    return let(F.lower(text), first)


def quote_from(text: Column) -> Column:
    """The first whole sentence of 25 to 240 characters, else the opening words after any number."""
    sentences = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.length(s).between(25, 240))
    opening = F.regexp_extract(text, r"(?s)[A-Z(].*", 0)
    opening = F.when(opening == "", text).otherwise(opening)
    cut = F.when(F.length(opening) > 160, F.regexp_replace(F.substring(opening, 1, 160), r"\s+\S*\z", "")).otherwise(opening)
    return F.coalesce(F.get(sentences, F.lit(0)), F.trim(cut))


def cite_from(text: Column) -> Column:
    """The first sentence of a citing length, else the opening characters; null for no text."""
    found = F.regexp_extract(text, CITED, 0)
    return F.trim(F.when(found != "", found).otherwise(F.substring(text, 1, 160)))


def summary_values(text: Column) -> Column:
    """struct: what a clause states for each field of the summary, null where it states nothing; and the bond's amount
    (empty where a clause on bonds has none)."""

    def values(low: Column) -> Column:
        bond = F.when(matches(text, BOND_TOPIC, True, low), F.regexp_extract(text, BOND_AMOUNT, 0))
        return F.struct(*[extracted(text, *how, low).alias(name) for name, how in SUMMARY.items()], bond.alias("bond"))

    return let(F.lower(text), values)


def summary_parts(values: Column) -> list[Column]:
    """Aggregates over a document's clauses: the first of each field in clause order, and the first three clauses as
    sources. Rows without values do not count."""
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("ord")))
    sources = F.array_sort(F.collect_list(F.when(values.isNotNull() & (F.col("ord") <= 3), F.struct("ord", "clause_id"))))
    return [*[first(values[name]).alias(name) for name in (*SUMMARY, "bond")], sources.alias("sources")]


def summary_fields() -> list[Column]:
    """The summary from the columns of ``summary_parts``."""
    return [F.lit(DOCUMENT_TYPE).alias("document_type"), *map(F.col, SUMMARY), F.when(F.col("bond") != "", F.col("bond")).alias("bond"), F.array_join(F.transform("sources", lambda x: x["clause_id"]), ",").alias("sources")]


def summary(clauses: DataFrame) -> DataFrame:
    """One row per document; one aggregation over values that each clause gives once."""
    rows = once(clauses.select("doc_id", "ord", "clause_id", "text"), summary=summary_values(F.col("text")))
    return rows.groupBy("doc_id").agg(*summary_parts(F.col("summary"))).select("doc_id", *summary_fields())


def glossary(text: Column) -> Column:
    """array<struct<term, start, n>>: the first occurrence of each term, unless an earlier term's overlaps it."""
    found = []
    for term, forms in GLOSSARY.items():
        pattern = rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(forms)})(?![\p{{L}}\p{{M}}\p{{N}}])"
        at = F.regexp_instr(text, F.lit(pattern))
        found.append(F.when(at > 0, F.struct(F.lit(term).alias("term"), (at - 1).alias("start"), F.length(F.regexp_extract(text, pattern, 0)).alias("n"))))
    every = F.array_compact(F.array(*found))
    meets = lambda x, y: (y["start"] < x["start"] + x["n"]) & (x["start"] < y["start"] + y["n"])
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: meets(x, y)))


def segments(text: Column, marks: Column) -> Column:
    """array<struct<term, text>>: the text cut at all marks (struct<term, start, n>, none of which overlap), what stands
    between them with a null term. The segments joined are the text."""
    cuts = F.array_sort(F.transform(marks, lambda m: F.struct(m["start"], m["n"], m["term"])))

    def cut(m: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(cuts, i - 1)["start"] + F.get(cuts, i - 1)["n"]).otherwise(0)
        return F.array(F.struct(F.lit(None).cast("string").alias("term"), F.substring(text, before + 1, m["start"] - before).alias("text")), F.struct(m["term"], F.substring(text, m["start"] + 1, m["n"]).alias("text")))

    last = F.get(cuts, F.size(cuts) - 1)
    rest = F.struct(F.lit(None).cast("string").alias("term"), F.when(F.size(cuts) > 0, F.substring(text, last["start"] + last["n"] + 1, F.length(text))).otherwise(text).alias("text"))
    return F.filter(F.concat(F.flatten(F.transform(cuts, cut)), F.array(rest)), lambda x: x["text"] != "")
