"""Lines to blocks to clauses, as gaps-and-islands over one partitioning by document.

Every pass is a window over (doc_id, line) or (doc_id, block): whether a line starts a block depends on itself and the
line before, so blocks are running sums of starts; section titles carry forward with ``last``; fragments merge upward
by a second running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import title_case

# What marks headings, sub-items, page furniture, sentences and titles.
NUMBERED = r"^\s*(\d{1,3}(?:\.\d{1,3}){1,3}[.)]?|\d{1,3}[.)])\s+(\S.*)$"
NAMED = r"^\s*(clause|section|article|annexure|schedule|appendix)\s+([\dIVXivx.]+)\b[.:)]?\s*(.*)$"
SUB_ITEM = r"^\s*\(?([a-z]|[ivx]{1,4})\)\s+(\S.*)$"
NOISE = r"^\s*(page\s+\d+(\s*(of|/)\s*\d+)?|[-–—_*=.\s]{3,}|\d{1,3}|confidential|private\s*&?\s*confidential)\s*$"
LEAD = r"^([A-Z][^.]{2,40})\.\s+\S"
VERB = r"(^|[^A-Za-z0-9_])(shall|will|may|must|is|are|was|were|agrees?|be)($|[^A-Za-z0-9_])"
SENTENCE = r"""^[\p{Lu}\p{N}"'(][\s\S]*[.!?।]["')\]]*$"""


def _end(pattern: str) -> str:
    """Java's $ also matches before a last line break."""
    return pattern.removesuffix("$") + r"\z"


def words_in(text: Column) -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))


def is_caps(line: Column) -> Column:
    return F.length(line).between(1, 80) & ~line.rlike("[a-z]") & line.rlike("[A-Z]") & (words_in(line) <= 8)


def lead_heading(rest: Column) -> Column:
    """A short lead-in in front of the body: at most five words and no verb."""
    lead = F.regexp_extract(F.trim(rest), LEAD, 1)
    return F.when((lead != "") & (words_in(lead) <= 5) & ~lead.rlike("(?i)" + VERB), lead)


def headings(lines: DataFrame) -> DataFrame:
    """Adds label, heading, is_heading and is_title to lines (doc_id, line_no, text, page) with trimmed text."""
    t = F.col("text")
    sub = t.rlike("(?i)" + _end(SUB_ITEM))
    numbered, named, caps = t.rlike(_end(NUMBERED)), t.rlike("(?i)" + _end(NAMED)), is_caps(t)
    number = F.regexp_replace(F.regexp_extract(t, _end(NUMBERED), 1), r"[.)]\z", "")
    word = F.regexp_extract(t, "(?i)" + _end(NAMED), 1)
    name = F.trim(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))), F.lit(" "), F.regexp_extract(t, "(?i)" + _end(NAMED), 2)))
    label = F.when(sub, None).when(numbered, number).when(named, name)
    heading = F.when(sub, None).when(numbered, lead_heading(F.regexp_extract(t, _end(NUMBERED), 2))).when(named, lead_heading(F.regexp_extract(t, "(?i)" + _end(NAMED), 3))).when(caps, title_case(t))
    is_heading = ~sub & (numbered | named | caps)
    return lines.select("*", label.alias("label"), heading.alias("heading"), is_heading.alias("is_heading"), (~sub & ~numbered & ~named & caps).alias("is_title"))


def kept_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and page furniture; after_blank tells of a blank line since the last kept one."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    trimmed = lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", ""))
    counted = trimmed.withColumn("blanks", F.sum((F.col("text") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = counted.where((F.col("text") != "") & ~F.col("text").rlike("(?i)" + _end(NOISE)))
    return kept.withColumn("after_blank", F.col("blanks") > F.coalesce(F.lag("blanks").over(order), F.lit(0))).drop("blanks")


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, label, heading, text, n_lines, page, page_end)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = headings(kept_lines(lines))
    first = F.row_number().over(order) == 1
    after_title = F.coalesce(F.lag("is_title").over(order), F.lit(False))
    start = F.col("is_heading") | first | (F.col("after_blank") & ~after_title)
    rows = rows.withColumn("block", F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    content = F.when(~F.col("is_title"), F.struct("line_no", "text"))
    made = rows.groupBy("doc_id", "block").agg(
        F.min_by("label", "line_no").alias("label"), F.min_by("heading", "line_no").alias("heading"), F.sort_array(F.collect_list(content)).alias("lines"),
        F.min(F.when(~F.col("is_title"), F.col("page"))).alias("page"), F.max(F.when(~F.col("is_title"), F.col("page"))).alias("page_end"),
    )
    made = made.withColumn("n_lines", F.size("lines"))
    return made.withColumn("text", joined("lines")).where("n_lines > 0").drop("lines")


def joined(lines: str) -> Column:
    return F.trim(F.regexp_replace(F.array_join(F.transform(lines, lambda x: x["text"]), " "), r"\s+", " "))


def fold_sections(found: DataFrame) -> DataFrame:
    """Section titles in front of their first child become headings of the clauses under them."""
    order = Window.partitionBy("doc_id").orderBy("block")
    label, text, after = F.col("label"), F.col("text"), F.lead("label").over(order)
    # The text without its own label, compared without case; then a mark and spaces.
    own = F.lower(F.left(text, F.length(label))) == F.lower(label)
    rest = F.when(own, F.regexp_replace(F.substring(text, F.length(label) + 1, F.length(text)), r"^[.):]?\s*", "")).otherwise(text)
    titled = label.isNotNull() & F.coalesce(F.startswith(after, F.concat(label, F.lit("."))), F.lit(False)) & (F.col("n_lines") == 1)
    titled = titled & F.length(rest).between(1, 80) & ~rest.rlike(r"[.;:!?]\z") & (words_in(rest) <= 8)
    rows = found.withColumn("title", F.when(titled, F.when(~rest.rlike("[a-z]"), title_case(rest)).otherwise(rest)))
    # All running values follow one order, so that a document's blocks are sorted once.
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("title").isNotNull()
    rows = rows.withColumns({"of": F.last(F.when(begins, label), ignorenulls=True).over(so_far), "named": F.last("title", ignorenulls=True).over(so_far), "begun": F.max(F.when(begins, F.col("block"))).over(so_far)})
    left = ~begins & label.isNotNull() & ~F.startswith(label, F.concat("of", F.lit(".")))
    # A section is left from its first block with a label of another on.
    rows = rows.withColumn("left", F.coalesce(F.max(F.when(left, F.col("block"))).over(so_far) > F.col("begun"), F.lit(False)))
    inside = ~F.col("left") & F.col("named").isNotNull() & label.isNotNull() & F.col("heading").isNull()
    return rows.withColumn("heading", F.when(inside, F.col("named")).otherwise(F.col("heading"))).where("title is null").drop("title", "of", "named", "begun", "left")


def merge_fragments(found: DataFrame) -> DataFrame:
    """Short unlabelled blocks that are no sentence join the block above."""
    order = Window.partitionBy("doc_id").orderBy("block")
    n = F.length("text")
    fragment = (n < LIMITS.fragment_chars) & ((n < LIMITS.sentence_chars) | ~F.col("text").rlike(_end(SENTENCE)))
    up = F.col("label").isNull() & F.col("heading").isNull() & fragment & (F.row_number().over(order) > 1)
    rows = found.withColumn("island", F.sum((~up).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("doc_id", "island").agg(
        F.min_by("label", "block").alias("label"), F.min_by("heading", "block").alias("heading"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"),
        F.min("page").alias("page"), F.max("page_end").alias("page_end"),
    )
    return merged.withColumn("text", joined("parts")).drop("parts")


def split_long(text: Column, limit: int = LIMITS.clause_chars) -> Column:
    """Parts of at most ``limit`` characters, cut behind the last sentence end past the middle, else at the limit."""

    def last(window: Column, mark: str) -> Column:
        back = F.instr(F.reverse(window), F.lit(mark[::-1]))
        return F.when(back > 0, F.length(window) - back - 1).otherwise(-1)

    def cut(rest: Column) -> Column:
        window = F.substring(rest, 1, limit)
        end = F.greatest(last(window, ". "), last(window, "; "), last(window, "? "))
        return F.when(F.length(rest) <= limit, F.length(rest)).when(end > limit * 0.5, end + 1).otherwise(limit)

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        at = cut(rest)
        part = F.trim(F.substring(rest, F.lit(1), at))
        return F.when(F.length(rest) == 0, acc).otherwise(F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"), F.trim(F.substring(rest, at + 1, F.length(rest))).alias("rest")))

    most = F.sequence(F.lit(0), F.floor(F.length(text) / F.lit(limit // 2)).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), text.alias("rest"))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(most, start, step)["parts"])


def segment(lines: DataFrame, limit: int = LIMITS.clause_chars, most: int = LIMITS.clauses) -> DataFrame:
    """(doc_id, clause_id, ord, label, heading, text, page, page_end); parts of a split block but those of the
    document's first carry no label or heading (a known quirk, kept)."""
    merged = merge_fragments(fold_sections(blocks(lines)))
    parts = merged.select("doc_id", "island", "label", "heading", "page", "page_end", F.col("text").alias("whole"), F.posexplode(split_long(F.col("text"), limit)).alias("k", "text"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("island", "k")) - 1
    parts = parts.withColumn("ord", ord_).where(F.col("ord") < most)
    tail = (F.col("ord") > 0) & (F.col("text") != F.col("whole"))
    return parts.select(
        "doc_id", F.concat(F.lit("c"), F.when(F.col("ord") < 999, F.lpad((F.col("ord") + 1).cast("string"), 3, "0")).otherwise((F.col("ord") + 1).cast("string"))).alias("clause_id"), "ord",
        F.when(~tail, F.col("label")).alias("label"), F.when(~tail, F.col("heading")).alias("heading"), "text", "page", "page_end",
    )


def page_range(lines: DataFrame) -> DataFrame:
    """(doc_id, page, page_end): the first and last page of a document's clauses. Fragments that join the block above, and
    long blocks that are cut, keep their pages between them, so that blocks give what clauses would, without a text."""
    found = fold_sections(blocks(lines))
    return found.groupBy("doc_id").agg(F.min("page").alias("page"), F.max("page_end").alias("page_end"))


def parsed(docs: DataFrame, clauses: DataFrame, most: int = LIMITS.total_chars) -> DataFrame:
    """(doc_id, reason, clauses, chars) for all documents (doc_id): a reason where nothing, or too much, was found."""
    found = clauses.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.length("text")).alias("chars"))
    met = docs.join(found, "doc_id", "left")
    reason = F.when(F.col("clauses").isNull(), "NO_TEXT").when(F.col("chars") > most, "TOO_MUCH_TEXT")
    return met.select("doc_id", reason.alias("reason"), F.coalesce("clauses", F.lit(0)).cast("long").alias("clauses"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
