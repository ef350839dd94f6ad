"""Durations, amounts and notice periods in normalised clause text, as expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import holds, java, lookup, sql_case, sql_text
from .rows import let

# Numbers that are read when spelled out, days of a unit, multipliers, and who is who.
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "eighteen": 18, "twenty": 20, "twenty-four": 24, "twenty four": 24, "thirty": 30, "forty-five": 45,
    "forty five": 45, "sixty": 60, "ninety": 90, "one hundred eighty": 180,
}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
MULTIPLIERS = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
EMPLOYEE = r"\b(employee|you|your|he/she|his/her)\b"
EMPLOYER = r"\b(company|employer|organisation|organization|management)\b"
WORDS = "|".join(sorted(NUMBERS, key=len, reverse=True))
UNITS = "(days|day|weeks|week|months|month|years|year)"
DURATION = rf"(?:({WORDS})|(\d{{1,4}}))\s*(?:\(\s*\d{{1,4}}\s*\)\s*)?{UNITS}"
AMOUNT = r"(?:(?:rs\.?|inr|₹)\s*)?(?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:thousand|lakhs?|lacs?|crores?)?"
MARKED = r"^(rs|inr|₹)"
DIGITS = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
SCALE = r"(thousand|lakhs?|lacs?|crores?)$"


#: Every duration holds one of these, and every amount of money.
UNIT_WORDS = tuple(UNIT_DAYS)
MONEY_WORDS = ("rs", "inr", "₹", "thousand", "lakh", "lac", "crore")


def _found(text: Column, pattern: str, words: tuple[str, ...]) -> Column:
    """All matches; none, without a search, for texts that hold none of the words; null for null."""
    found = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    return F.when(~holds(text, words), F.array().cast("array<string>")).otherwise(found)


def durations(text: Column) -> Column:
    """array<struct<days, value, unit, text>> in order; zero lengths are left out."""

    def one(m: Column) -> Column:
        digits = F.regexp_extract(m, r"^(\d{1,4})", 1)
        value = F.when(digits != "", digits.cast("int")).otherwise(lookup(F.regexp_extract(m, f"^({WORDS})", 1), NUMBERS))
        unit = F.regexp_extract(m, r"(day|week|month|year)s?$", 1)
        return let(F.struct(value.alias("value"), unit.alias("unit")), lambda x: F.struct((x["value"] * lookup(x["unit"], UNIT_DAYS)).alias("days"), x["value"].alias("value"), x["unit"].alias("unit"), m.alias("text")))

    return F.filter(F.transform(_found(text, DURATION, UNIT_WORDS), one), lambda d: d["value"] > 0)


def sql_durations(text: str) -> str:
    """Its days and texts in SQL: a list of structs."""
    value = f"CASE WHEN regexp_extract(m, '^([0-9]{{1,4}})', 1) <> '' THEN CAST(regexp_extract(m, '^([0-9]{{1,4}})', 1) AS INT) ELSE {sql_case(f'regexp_extract(m, {sql_text("^(" + WORDS + ")")}, 1)', NUMBERS)} END"
    unit = "regexp_extract(m, '(day|week|month|year)s?$', 1)"
    days = f"({value}) * {sql_case(unit, UNIT_DAYS)}"
    return f"list_filter(list_transform(regexp_extract_all({text}, {sql_text(DURATION)}), lambda m: {{'days': {days}, 'value': {value}, 'unit': {unit}, 'text': m}}), lambda d: d.value > 0)"


def amounts(text: Column) -> Column:
    """array<struct<rupees, text>>: numbers with a currency mark or an Indian multiplier, above zero."""

    def one(m: Column) -> Column:
        base = F.replace(F.regexp_extract(m, DIGITS, 1), F.lit(","), F.lit("")).cast("double")
        scale = F.regexp_extract(m, SCALE, 1)
        return F.struct((base * F.coalesce(lookup(scale, MULTIPLIERS), F.lit(1)).cast("double")).alias("rupees"), F.trim(m).alias("text"))

    money = F.filter(_found(text, AMOUNT, MONEY_WORDS), lambda m: m.rlike(MARKED) | m.rlike(SCALE))
    return F.filter(F.transform(money, one), lambda a: a["rupees"] > 0)


def sql_amounts(text: str) -> str:
    base = f"CAST(replace(regexp_extract(m, {sql_text(DIGITS)}, 1), ',', '') AS DOUBLE)"
    scale = f"regexp_extract(m, {sql_text(SCALE)}, 1)"
    money = f"list_filter(regexp_extract_all({text}, {sql_text(AMOUNT)}), lambda m: regexp_matches(m, {sql_text(MARKED)}) OR regexp_matches(m, {sql_text(SCALE)}))"
    return f"list_filter(list_transform({money}, lambda m: {{'text': trim(m), 'rupees': {base} * CAST({sql_case(scale, MULTIPLIERS, '1')} AS DOUBLE)}}), lambda x: x.rupees > 0)"


def format_inr(rupees: Column) -> Column:
    """Rs. 2,00,000: the last three digits, then pairs."""
    digits = F.round(rupees, 0).cast("decimal(20,0)").cast("string")
    rest = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"\B(?=(\d{2})+(?!\d))", ",")
    return F.when(F.length(digits) <= 3, F.concat(F.lit("Rs. "), digits)).otherwise(F.concat(F.lit("Rs. "), rest, F.lit(","), F.right(digits, F.lit(3))))


def sql_format_inr(rupees: str) -> str:
    d = f"CAST(CAST(round({rupees}) AS BIGINT) AS VARCHAR)"
    rest = f"reverse(regexp_replace(reverse(left({d}, length({d}) - 3)), '(..)', '\\1,', 'g'))"
    return f"CASE WHEN length({d}) <= 3 THEN 'Rs. ' || {d} ELSE 'Rs. ' || ltrim({rest}, ',') || ',' || right({d}, 3) END"


def first_at(text: Column, pattern: str) -> Column:
    """Place of the first match from 1; 0 if there is none."""
    return F.regexp_instr(text, F.lit(java(pattern)))


def notice(text: Column) -> Column:
    """struct<employee, employer, unattributed>: per side its longest notice (the first of equals), else null.

    Each sentence with the word belongs to the side that it names first; a sentence that names none is unattributed.
    """
    sentences = F.filter(F.split(text, r"[.;\n]"), lambda s: F.contains(s, F.lit("notice")))

    def owner(at: Column) -> Column:
        e, c = at["e"], at["c"]
        return F.when((e > 0) & ((c == 0) | (e < c)), "employee").when(c > 0, "employer").otherwise("none")

    def owned(s: Column) -> Column:
        said = F.struct(let(F.struct(first_at(s, EMPLOYEE).alias("e"), first_at(s, EMPLOYER).alias("c")), owner).alias("owner"), durations(s).alias("d"))
        return let(said, lambda x: F.transform(x["d"], lambda d: F.struct(x["owner"].alias("owner"), d["days"].alias("days"), d["text"].alias("text"))))

    def longest(every: Column, owner: str) -> Column:
        mine = F.transform(F.filter(every, lambda d: d["owner"] == owner), lambda d, i: F.struct(d["days"].alias("days"), (-i).alias("i"), d["text"].alias("text")))
        return let(F.array_max(mine), lambda top: F.when(top.isNotNull(), F.struct(top["days"].alias("days"), top["text"].alias("text"))))

    def sides(every: Column) -> Column:
        return F.struct(longest(every, "employee").alias("employee"), longest(every, "employer").alias("employer"), longest(every, "none").alias("unattributed"))

    return let(F.flatten(F.transform(sentences, owned)), sides)


def sql_first_at(text: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {sql_text(pattern)}) THEN length(regexp_extract({text}, {sql_text('(?s)^(.*?)' + pattern)}, 1)) + 1 ELSE 0 END"
