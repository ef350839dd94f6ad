"""Text scalars: normalisation, tokens, token sets, titles, prompt sanitising. All are Catalyst expressions, but texts
with characters that compatibility composition may change (rare ones) are normalised in Python, in Arrow batches."""

from __future__ import annotations

import re
import string
import unicodedata
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import holds, java
from .rows import let

# Characters that normalisation drops, and those that it folds.
IGNORABLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032\u00b4\u02bc"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212"
ELLIPSIS = "\u2026"
FOLDED = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES
FOLDS_TO = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)
#: White space as the data contract's patterns understand it.
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ASCII_WS = "\t\n\x0b\x0c\r "
STOP_WORDS = "the a an of to and or in for by with shall any this that be is as on at from such".split()
#: Listed one by one, as Java finds these in one table and tries ranges one after the other.
ASCII_WORDS = " " + string.digits + string.ascii_letters
MINOR_WORDS = "a an and as at by for in of on or the to with".split()
FENCES = "document question previous_turns findings already_covered_questions unanswered_questions pair version_a version_b".split()


#: Characters that NFKC leaves as they are, whatever stands beside them, and those that normalisation drops, folds or
#: collapses before it matters. All others send their text to the exact version.
STABLE = (
    r"\x00-\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a4-\u03c1\u03c3-\u03ce"
    r"\u0400-\u0482\u048a-\u04ff\u0904-\u0928\u092a-\u0930\u0932\u0933\u0935-\u0939\u0964-\u0970\u20a0-\u20a7\u20a9-\u20c0\u2020-\u2023\u2030\u2031\u2190-\u21ff\u25a0-\u25ff"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
)


def normalize(text: Column, trim: bool = False) -> Column:
    """NFKC, ignorables dropped, punctuation folded, white space collapsed and trimmed, lower case.

    trim: as if trimmed before, so that white space in front goes without the combining marks behind it.
    """
    # The function gets null for all texts that do not need it, and gives null for these.
    return F.coalesce(normalize_text(F.when(is_rare(text), trimmed(text) if trim else text)), normalize_plain(text))


def is_rare(text: Column) -> Column:
    """Whether a text holds characters that NFKC may change, or combining marks."""
    # The short test keeps most texts from the long one.
    return (F.octet_length(text) != F.length(text)) & text.rlike(f"[^{STABLE}{IGNORABLE}{FOLDED}{ELLIPSIS}{WS}]")


def normalize_plain(text: Column) -> Column:
    """``normalize`` of texts that are not rare."""
    return F.when(F.octet_length(text) != F.length(text), normalize_stable(text)).otherwise(collapse(text, ASCII_WS))


def moved(text: Column) -> Column:
    """The text, but null where every normalised character stands where it stood: in ASCII with single blanks, none in front."""
    even = (F.octet_length(text) == F.length(text)) & ~holds(text, (*ASCII_WS.replace(" ", ""), "  ")) & ~F.startswith(text, F.lit(" "))
    return F.when(~even, text)


def normalize_last(text: Column) -> Column:
    """struct<text, start, end, last>: the normalised text, the begin and end of the cluster that each of its characters came
    from, and the end of the last one (null where nothing is left). Texts whose characters keep their places are numbered by
    expressions; all others are mapped in Arrow batches."""
    left = F.rtrim(text)
    count = lambda first: F.when(F.length(left) > 0, F.sequence(F.lit(first), F.length(left) + (first - 1))).otherwise(F.array().cast("array<int>"))
    even = F.struct(F.lower(left).alias("text"), count(0).alias("start"), count(1).alias("end"))
    found = F.coalesce(normalize_exact(moved(text)), F.when(text.isNotNull(), even))
    return let(found, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(m["end"], F.lit(-1)).alias("last")))


def origin_range(moved: Column, first: Column, after: Column) -> Column:
    """struct<start, end>: where a range of the normalised text (from 0, half open) lies in the original one, of which only
    ``moved`` is needed; null for null."""
    m = normalize_exact(F.when(first.isNotNull(), moved))
    found = F.struct(F.get(m["start"], first).alias("start"), F.get(m["end"], after - 1).alias("end"))
    return F.when(first.isNotNull(), F.when(moved.isNull(), F.struct(first.alias("start"), after.alias("end"))).otherwise(found))


def collapse(text: Column, spaces: str) -> Column:
    """White space to one space each, trimmed, lower case. A space alone stays as it is: most matches of a plain run of
    white space would write what they read."""
    more = spaces.replace(" ", "")
    flat = F.regexp_replace(text, f"[{more}][{spaces}]*| [{spaces}]+", " ")
    if spaces == ASCII_WS:
        # Most texts hold single spaces only, and finding that out is cheaper than the expression.
        flat = F.when(holds(text, (*more, "  ")), flat).otherwise(text)
    return F.lower(F.trim(flat))


def normalize_stable(text: Column) -> Column:
    """The same for text that NFKC leaves as it is."""
    text = F.regexp_replace(text, f"[{IGNORABLE}]", "")
    return collapse(F.replace(F.translate(text, FOLDED, FOLDS_TO), F.lit(ELLIPSIS), F.lit("...")), WS)


def sql_collapsed(text: str) -> str:
    quotes = FOLDS_TO.replace("'", "''")
    return f"regexp_replace(replace(translate(regexp_replace({text}, '[{IGNORABLE}]', '', 'g'), '{FOLDED}', '{quotes}'), '{ELLIPSIS}', '...'), '[{WS}]+', ' ', 'g')"


def sql_normalize(text: str) -> str:
    return f"lower(trim({sql_collapsed(text)}))"


def sql_shown(text: str) -> str:
    """How many normalised characters are known once the first, the first two, ... of the text's have been read."""
    return f"list_transform(range(1, length({text}) + 1), lambda k: length(ltrim({sql_collapsed(f'substr({text}, 1, CAST(k AS INT))')})))"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit("".join(sorted(SPACES))))


def sql_trimmed(text: str) -> str:
    return f"trim({text}, '{''.join(sorted(SPACES))}')"


ORIGIN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType()))])
#: The characters of ``WS``.
SPACES = frozenset(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_FOLD = dict(zip(FOLDED, FOLDS_TO, strict=True)) | {ELLIPSIS: "..."}


def normalized_with_origin(text: str | None) -> tuple[str, list[int], list[int]] | None:
    """Normalised text, and for each of its characters the begin and end of the cluster that it came from.

    A cluster is a code point and the combining marks behind it; offsets are code points.
    """
    if text is None:
        return None
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    gap: tuple[int, int] | None = None
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and unicodedata.category(text[to])[0] == "M":
            to += 1
        cluster = text[at:to]
        if cluster in IGNORABLE:
            pass
        elif any(c in SPACES for c in cluster):
            gap = gap or ((at, to) if out else None)
        else:
            pieces = [(" ", *gap)] if gap else []
            gap = None
            pieces.append((_FOLD.get(cluster) or unicodedata.normalize("NFKC", cluster).lower(), at, to))
            for piece, a, b in pieces:
                out += piece
                start += [a] * len(piece)
                end += [b] * len(piece)
        at = to
    return "".join(out), start, end


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the basic plane: whether ``mapped`` knows it, whether it is white space, how many characters it
    gives and which; a mark or a character that NFKC may change is not known."""
    size, gives = np.ones(0x10000, np.int64), np.arange(0x10000, dtype=np.uint32)
    known, space = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
    for m in re.finditer(f"[{STABLE}{IGNORABLE}{FOLDED}{ELLIPSIS}{WS}]", "".join(map(chr, range(0xD800))) + "\ufeff"):
        c = ord(m[0])
        out = " " if m[0] in SPACES else _FOLD.get(m[0]) or m[0].lower()
        known[c], space[c], size[c], gives[c] = len(set(out)) == 1, m[0] in SPACES and m[0] not in IGNORABLE, 0 if m[0] in IGNORABLE else len(out), ord(out[0])
    return known, space, size, gives


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _origins(text: pa.Array, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (start, end)]
    return pa.StructArray.from_arrays([text, *lists], ["text", "start", "end"])


def mapped(texts: list[str]) -> pa.Array:
    """``normalized_with_origin`` of texts of known characters, all at once: each is a cluster of its own."""
    _, space, size, gives = _characters()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    c, row = _points(texts), np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.flatnonzero(size[c] > 0)
    c, row, at = c[kept], row[kept], at[kept]
    blank = space[c]
    # A run of white space gives one, at its first place, if there is something else of the text on both sides.
    last = np.full(len(texts), -1)
    last[row[~blank]] = np.flatnonzero(~blank)
    behind = np.zeros(len(c), bool)
    behind[1:] = ~blank[:-1] & (row[1:] == row[:-1])
    shown = np.flatnonzero(~blank | (behind & (np.arange(len(c)) < last[row])))
    n = size[c[shown]]
    start = np.repeat(at[shown], n)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[shown], n, len(texts)).astype(np.int64))])
    out = np.repeat(gives[c[shown]], n).tobytes().decode("utf-32-le")
    return _origins(pa.array([out[a:b] for a, b in pairwise(offsets.tolist())], pa.string()), offsets, start, start + 1)


def mapped_by_cluster(texts: list[str]) -> pa.Array:
    made = [normalized_with_origin(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(m[1]) for m in made])])
    return _origins(pa.array([m[0] for m in made], pa.string()), offsets, *(np.array([x for m in made for x in m[k]], np.int32) for k in (1, 2)))


@F.arrow_udf(ORIGIN)
def normalize_exact(text: pa.Array) -> pa.Array:
    """``normalized_with_origin`` for a column; null for null."""
    said = [(k, t) for k, t in enumerate(text.to_pylist()) if t is not None]
    known = _characters()[0]
    c = _points([t for _, t in said])
    odd = np.flatnonzero(~known[np.minimum(c, 0xFFFF)])
    begin = np.cumsum([0, *(len(t) for _, t in said)])
    rare = set(np.searchsorted(begin, odd, "right") - 1)
    parts = [[x for j, x in enumerate(said) if (j in rare) == by] for by in (False, True)]
    place = np.full(len(text), -1)
    place[[k for part in parts for k, _ in part]] = np.arange(len(said))
    made = pa.concat_arrays([make([t for _, t in part]) for make, part in zip((mapped, mapped_by_cluster), parts, strict=True)])
    return made.take(pa.array(place, mask=place < 0))


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalized_with_origin(t)[0])


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def sql_tokens(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda t: t <> '')"


def token_set(normalized: Column) -> Column:
    """Distinct content words: letters and digits only, longer than 2, no stop words."""
    # Cleaned as one text, and words by one expression each for all: functions on single words cost more than all else here.
    plain = F.octet_length(normalized) == F.length(normalized)
    clean = F.when(plain, F.regexp_replace(normalized, f"[^{ASCII_WORDS}]+", "")).otherwise(F.regexp_replace(normalized, r"[^\p{L}\p{N} ]+", ""))
    return F.array_except(F.regexp_extract_all(clean, F.lit("[^ ]{3,}"), F.lit(0)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def sql_token_set(normalized: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_distinct(list_filter(list_transform(string_split({normalized}, ' '), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda t: length(t) > 2 AND t NOT IN ({stop})))"


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct token arrays: both empty 1, one empty 0."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def title_case(line: Column) -> Column:
    """Title case by words: minor words stay lower but in front; a hyphen begins a capital."""
    words = F.split(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), " ")

    def word(w: Column, i: Column) -> Column:
        parts = F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
        return F.when((i > 0) & w.isin(MINOR_WORDS), w).otherwise(F.array_join(parts, "-"))

    return F.array_join(F.transform(words, word), " ")


FENCE = r"<\s*/?\s*(?:" + "|".join(FENCES) + r")\b[^>]*>"


def sanitize(text: Column) -> Column:
    """Neutralise fence tags in any spelling, and part adjacent square brackets, of text that goes into a prompt."""
    text = F.regexp_replace(text, "(?i)" + java(FENCE), "[tag]")
    return F.regexp_replace(F.regexp_replace(text, r"\[(?=\[)", "[ "), r"\](?=\])", "] ")


def sql_sanitize(text: str) -> str:
    text = f"regexp_replace({text}, '{FENCE}', '[tag]', 'gi')"
    for c in "[]":
        for _ in range(2):  # without look-ahead, every second pair of a run takes a second pass
            text = f"replace({text}, '{c}{c}', '{c} {c}')"
    return text
