"""Scalar functions over text columns. Each takes and gives a Column."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

ARABIC = "[\\u0600-\\u06FF]"
ARABIC_ALL = "[\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
#: White space that Python's split() and strip() know, as far as Java's regex has it.
_SPACES = "[\\s\\x1C-\\x1F\\x85\\p{Z}]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row though body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; no built-in function has it."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def contains_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def arabic_chars(text: Column, pattern: str = ARABIC) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def char_ratio(text: Column, pattern: str = ARABIC_ALL) -> Column:
    """Characters of the class among all but spaces and line feeds; 0 if there are none."""
    plain = F.translate(text, " \n", "")
    return F.when(F.length(plain) == 0, 0.0).otherwise(arabic_chars(plain, pattern) / F.length(plain))


def tidy(text: Column, normal: bool = True) -> Column:
    """Control characters but \\n and \\t dropped, NFC, runs of blanks to one, of three or more line feeds to two, trimmed."""
    kept = F.regexp_replace(text, "[\\p{C}&&[^\\n\\t]]", "")
    kept = nfc(kept) if normal else kept
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, "[ \\t]+", " "), "\\n{3,}", "\n\n"), f"^{_SPACES}|{_SPACES}$", "")


def search_form(text: Column, drop_other: bool = True) -> Column:
    """Vowel marks dropped, letter variants merged; drop_other: what is neither Arabic nor basic punctuation becomes a space."""
    plain = F.translate(F.regexp_replace(text, "[\\u064B-\\u065F\\u0670]", ""), "أإآى", "اااي")
    if drop_other:
        plain = F.regexp_replace(plain, "[^\\u0600-\\u06FF\\u0750-\\u077F\\s\\d،.؟!:]", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def topic_hints(text: Column, hints=fixed.TOPIC_HINTS) -> Column:
    """Names of the patterns found, comma-joined."""
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in hints])))


def is_page_anchor(text: Column) -> Column:
    return F.trim(text).rlike("^page_[0-9]+_[0-9]+$")


def is_title(text: Column) -> Column:
    """Not empty, no page anchor, four Arabic characters or more."""
    return F.coalesce((text != "") & ~is_page_anchor(text) & (arabic_chars(text) >= 4), F.lit(False))


def opens_chapter(text: Column) -> Column:
    """A short paragraph that is a chapter's title."""
    return text.rlike(f"(?U)^({'|'.join(fixed.CHAPTER_OPENERS)})\\b") & (F.length(text) < 120)


def sanitized(text: Column, normal: bool = True) -> Column:
    """NFC, HTML-escaped with quotes, white space to single spaces."""
    out = nfc(text) if normal else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _SPACES, " "))


def question_error(text: Column, clean: Column) -> Column:
    """Code of the first rule that the question breaks, or null: blank, short, long, suspicious."""
    least, most = fixed.QUESTION_LENGTH
    bad = F.lit(False)
    for pattern in fixed.SUSPICIOUS:
        bad = bad | text.rlike(pattern)
    blank = text.isNull() | (F.length(F.regexp_replace(text, _SPACES, "")) == 0)
    return F.when(blank, "blank").when(F.length(clean) < least, "short").when(F.length(clean) > most, "long").when(bad, "suspicious")


def school(name: Column) -> Column:
    """The school's name in its normal form, or null."""
    plain = F.lower(F.trim(name))
    return F.when(plain.isin(fixed.SCHOOLS), plain)


def tokens(text: Column) -> Column:
    """Words as \\w finds them, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)(\\w+)"), F.lit(1))


def language(text: Column) -> Column:
    words = F.array_distinct(tokens(text))
    n_id, n_en = (F.size(F.array_intersect(words, F.array(*map(F.lit, m)))) for m in (fixed.ID_MARKERS, fixed.EN_MARKERS))
    return F.when(contains_arabic(text), "ar").when(n_id >= n_en, "id").otherwise("en")


def density(text: Column) -> Column:
    """Distinct words among all, to four digits."""
    found = tokens(text)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.round(F.size(F.array_distinct(found)) / F.size(found), 4))


def input_type(text: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(text, f"^{_SPACES}|{_SPACES}$", "")))
    starts = lambda words: reduce(or_, [plain.startswith(w) for w in words])
    holds = lambda words: reduce(or_, [plain.contains(w) for w in words])
    kinds = fixed.INPUT_TYPES
    return (
        F.when(plain.endswith("?") | starts(fixed.QUESTION_STARTS), kinds[0]).when(starts(fixed.EXPLAIN_STARTS), kinds[1])
        .when(holds(fixed.RULING_WORDS), kinds[2]).when(holds(fixed.PROCEDURE_WORDS), kinds[3]).otherwise(kinds[4])
    )


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(fixed.STOPWORDS))


def truncated(text: Column, most: int = 280) -> Column:
    """Cut at the last space before the limit."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, "(?s) [^ ]*$", ""), F.lit(" ...")))


def excerpt(text: Column, most: int = 200) -> Column:
    return F.concat(F.regexp_replace(F.substring(text, 1, most), f"{_SPACES}$", ""), F.when(F.length(text) > most, "…").otherwise(""))


def display_name(slug: Column, names: dict[str, str] | None = None) -> Column:
    plain = F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[slug], plain) if names else plain


def level_label(level: Column, default: str = "—") -> Column:
    named = F.create_map(*[F.lit(x) for pair in fixed.AUTHORITY_LABEL.items() for x in pair])
    return F.coalesce(named[F.coalesce(level.cast("int"), F.lit(5))], F.lit(default))


def joined_notes(*notes: Column) -> Column:
    """Those that are neither null nor empty, joined by a blank line."""
    return F.concat_ws("\n\n", *[F.when(n != "", n) for n in notes])


def key_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)


def masked(token: Column) -> Column:
    return F.concat(F.substring(token, 1, 16), F.lit("..."))


def missing_fields(body: Column, fields: list[str]) -> Column:
    """Fields of a JSON object that are absent or empty."""
    values = [F.get_json_object(body, f"$.{f}") for f in fields]
    empty = lambda v: v.isNull() | v.isin("", "0", "0.0", "false", "null", "[]", "{}")
    return F.array_compact(F.array(*[F.when(empty(v), F.lit(f)) for f, v in zip(fields, values, strict=True)]))


def length_within(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))
