"""Column functions over text: normalisation, terms, concepts and token estimates.

All of them are built-in expressions that run inside the JVM. The one exception is NFKC, which
Spark has no function for: only texts that hold a character NFKC could change are handed to an
Arrow function, every other row passes it a null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.config import TermWeights
from folioscope.functions import fixed

# White space as Unicode sees it, without the three no-break spaces.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B),
    0x2028, 0x2029, 0x205F, 0x3000)))
NOT_SPACE = r"[^\s\x1C-\x1F\p{Z}]|[\u00A0\u2007\u202F]"
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

# Ranges of characters that are their own NFKC form and never combine with a neighbour.
NFKC_STABLE_RANGES = (
    (0x00, 0x7F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7),
    (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E),
    (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x20AC, 0x20AC),
    (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF),
)
# One range check settles ASCII; only other characters are looked up in the list.
_MAY_CHANGE = r"[^\x00-\x7F](?<![" + "".join(
    f"\\u{a:04X}-\\u{b:04X}" for a, b in NFKC_STABLE_RANGES[1:]) + "])"

# A capital that begins a word. Looked for by the capital itself, so that other characters cost one comparison.
CAMEL_START = "([A-Z])(?:(?<=[a-z0-9][A-Z])|(?<=[A-Z][A-Z])(?=[a-z]))"
TERM_TYPE = "array<struct<term:string,weight:double>>"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(~is_ascii(text) & text.rlike(_MAY_CHANGE), text)), text)


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, and forward slashes."""
    return F.replace(F.lower(nfkc(text)), F.lit("\\"), F.lit("/"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, and the ends are stripped."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def clip(text: Column, chars: int, marker: str) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(
        F.concat(F.substring(text, 1, chars), F.lit(marker)))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, CAMEL_START, " $1")


def wide_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, WIDE, ""))


def chunk_tokens(text: Column) -> Column:
    """Chunker estimate: wide characters count one, the others a quarter, each part rounded up;
    never below one."""
    wide = wide_count(text)
    estimate = wide + F.ceil((F.length(text) - wide) / 4.0)
    return F.greatest(F.lit(1), F.coalesce(estimate, F.lit(1))).cast("int")


def prompt_tokens(text: Column) -> Column:
    """Prompt estimate: both parts are added before rounding up; empty text costs nothing."""
    wide = wide_count(text)
    return F.coalesce(F.ceil(wide + (F.length(text) - wide) / 4.0), F.lit(0)).cast("int")


def file_extension(name: Column, missing: str) -> Column:
    """Lower-cased part after the last dot."""
    found = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(found == "", F.lit(missing)).otherwise(F.lower(found))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def concepts_in(compact: Column) -> Column:
    """Names of the concepts a normalised, blank-free text touches.

    A phrase counts when it occurs as written, or with all blanks removed on both sides. The
    second form includes the first, so one look at the blank-free text decides both.
    """
    lexicon = F.array(*[
        F.struct(F.lit(f"concept:{name}").alias("name"),
                 F.split(F.lit("|".join(p.replace(" ", "") for p in phrases)), r"\|")
                 .alias("phrases"))
        for name, phrases in fixed.CONCEPTS.items()])
    touched = F.filter(lexicon, lambda c: F.exists(
        c["phrases"], lambda phrase: F.contains(compact, phrase)))
    return F.transform(touched, lambda c: c["name"])


def _weighted(terms: Column, weight: float) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))


def _without_stop_words(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*fixed.STOP_WORDS))


def _grams(run: Column, size: int) -> Column:
    return F.when(
        F.length(run) >= size,
        F.transform(F.sequence(F.lit(1), F.length(run) - F.lit(size - 1)),
                    lambda i: F.substring(run, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def latin_terms(normalized: Column, weights: TermWeights) -> Column:
    """Runs of two or more Latin letters or digits, one entry per occurrence."""
    runs = F.regexp_extract_all(normalized, F.lit("[a-z0-9]{2,}"), 0)
    return _weighted(_without_stop_words(runs), weights.latin)


def han_terms(runs: Column, weights: TermWeights) -> Column:
    """Runs of Han characters: the whole run when it is short, and all its 2- and 3-grams."""
    whole = _weighted(_without_stop_words(F.filter(runs, lambda r: F.length(r) <= 5)),
                      weights.han_run)
    grams = _weighted(
        _without_stop_words(F.flatten(F.transform(
            runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))),
        weights.han_gram)
    return F.when(F.size(runs) > 0, F.concat(whole, grams)).otherwise(F.array().cast(TERM_TYPE))


def concept_terms(compact: Column, weights: TermWeights) -> Column:
    return _weighted(concepts_in(compact), weights.concept)


def sum_of_weights(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["weight"])


def jaccard_terms(text: Column) -> Column:
    """Distinct lower-cased words of two or more letters, digits or underscores."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0))


def jaccard(left_terms: Column, right_terms: Column, same_path: Column,
            floor: float = 0.35) -> Column:
    shared = F.size(F.array_intersect(left_terms, right_terms))
    either = F.size(F.array_union(left_terms, right_terms))
    value = shared / either
    return (F.when((F.size(left_terms) == 0) | (F.size(right_terms) == 0), F.lit(0.0))
            .when(same_path, F.greatest(value, F.lit(floor)))
            .otherwise(value))


def register_sql_functions(spark) -> None:
    """Makes the scalar helpers callable from SQL text."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION chunk_tokens(t STRING) RETURNS INT RETURN
          greatest(1, coalesce(CAST(
            (length(t) - length(regexp_replace(t, r'[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]', '')))
            + ceil(length(regexp_replace(t, r'[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]', '')) / 4.0)
            AS INT), 1))""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION prompt_tokens(t STRING) RETURNS INT RETURN
          coalesce(CAST(ceil(
            (length(t) - length(regexp_replace(t, r'[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]', '')))
            + length(regexp_replace(t, r'[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]', '')) / 4.0)
            AS INT), 0)""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION jaccard_terms(a STRING, b STRING) RETURNS DOUBLE RETURN
          CASE WHEN size(regexp_extract_all(lower(a), r'[\\p{L}\\p{N}_]{2,}', 0)) = 0
                 OR size(regexp_extract_all(lower(b), r'[\\p{L}\\p{N}_]{2,}', 0)) = 0 THEN 0D
               ELSE size(array_intersect(regexp_extract_all(lower(a), r'[\\p{L}\\p{N}_]{2,}', 0),
                                         regexp_extract_all(lower(b), r'[\\p{L}\\p{N}_]{2,}', 0)))
                  / size(array_union(regexp_extract_all(lower(a), r'[\\p{L}\\p{N}_]{2,}', 0),
                                     regexp_extract_all(lower(b), r'[\\p{L}\\p{N}_]{2,}', 0))) END""")
    spark.udf.register("normalize_text", _normalize_text_udf)


@F.pandas_udf(T.StringType())
def _normalize_text_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None
                     else unicodedata.normalize("NFKC", t).lower().replace("\\", "/"))
