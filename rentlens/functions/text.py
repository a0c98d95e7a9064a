"""Text column expressions: money, numbers, types, places, furnishing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions.numeric import finite

# --- fixed values: white space as Python's strip and \s take it, no-break space included ---
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NUMBER = rf"^{BLANK}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?){BLANK}*$"
KHMER_DIGITS = "០១២៣៤៥៦៧៨៩"
ASCII_DIGITS = "0123456789"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, KHMER_DIGITS, ASCII_DIGITS)


def decimal_text(c: Column) -> Column:
    """Decimal number of a whole text, or null; a number too large for a double is infinite."""
    return F.regexp_extract(c.cast("string"), NUMBER, 1).try_cast("double")


def to_double(c: Column) -> Column:
    """Lenient numeric cast: what is not a finite decimal number becomes null."""
    return finite(decimal_text(c))


def money_text(c: Column, mode: str = "class") -> Column:
    """Rent text without its decoration. ``class`` removes every character of the set ``$ , / m o n t h``
    and blanks; ``tokens`` removes ``$``, ``,`` and the words ``/month`` and ``permonth``."""
    if mode == "class":
        return F.translate(c.cast("string"), f"$,/month{BLANKS}", "")
    return F.regexp_replace(c.cast("string"), r"[\$,]|/month|permonth", "")


def parse_money(c: Column, mode: str = "class") -> Column:
    """Rent text to a number, see ``money_text``."""
    return to_double(money_text(c, mode))


def number_in(c: Column) -> Column:
    """First unsigned decimal number in a text, infinite if too large."""
    return F.regexp_extract(ascii_digits(c.cast("string")), r"(\d+\.?\d*)", 1).try_cast("double")


def first_number(c: Column) -> Column:
    return finite(number_in(c))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the others.

    ASCII words between spaces, the usual case, need no pattern that cuts the runs.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cut = F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )
    return F.when(F.rlike(c, F.lit("^[A-Za-z ]*$")), F.initcap(c)).otherwise(cut)


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def normalize_type(c: Column, names: Mapping[str, str], default: str | None) -> Column:
    """Map a type by its trimmed lower-case text; unknown gives ``default``, or title case if None."""
    text = strip(c)
    other = title_case(text) if default is None else F.lit(default)
    return F.coalesce(lookup(F.lower(text), names), other)


def clean_type(c: Column) -> Column:
    return normalize_type(c, vocab.CLEAN_TYPES, vocab.CLEAN_TYPE_DEFAULT)


def model_type(c: Column) -> Column:
    """Type as the model knows it: aliases resolved, unknown to the default."""
    known = {t.lower(): t for t in vocab.MODEL_TYPES} | vocab.TRAIN_ALIASES
    return normalize_type(collapse(c), known, vocab.MODEL_TYPE_DEFAULT)


def serve_type(c: Column) -> Column:
    """Type by the serving aliases; an unknown name stays, in title case."""
    return normalize_type(
        F.coalesce(F.nullif(c, F.lit("")), F.lit(vocab.MODEL_TYPE_DEFAULT)), vocab.SERVE_ALIASES, None
    )


def normalize_furnished(c: Column, default: str = vocab.FURNISHED_DEFAULT) -> Column:
    text = strip(c)
    return F.when(c.isNull() | F.lower(text).isin("", "nan", "none"), default).otherwise(title_case(text))


def furnished_from_text(c: Column, keywords=None, default: str = vocab.FURNISHED_DEFAULT) -> Column:
    """First furnishing label, in priority order, one of whose keywords the text contains."""
    labels = []
    for label, words in keywords or vocab.FURNISHED_KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(c, F.lit(word))
        labels.append(F.when(hit, F.lit(label)))
    return F.when(c.isNotNull(), F.coalesce(*labels, F.lit(default)))


def furnished_flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*vocab.FURNISHED_YES), F.lit(False)).cast("double")


def geo_clean(c: Column, stopwords: Sequence[str] = tuple(vocab.GEO_STOPWORDS)) -> Column:
    """Place text without administrative words and separators, in lower case; null gives ''."""
    noise = "|".join([*stopwords, "[,-]"])
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), noise, " "))


def in_scope(c: Column, token_groups: Sequence[Sequence[str]]) -> Column:
    """True when the cleaned place contains a token of every group."""
    text = geo_clean(c)
    out = F.lit(True)
    for group in token_groups:
        hit = F.lit(False)
        for token in group:
            hit = hit | F.contains(text, F.lit(token))
        out = out & hit
    return out


def place_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def last_token(c: Column, separator: str = ",") -> Column:
    return strip(F.element_at(F.split(c, separator), -1))


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern, in order, that the text matches."""
    text = ascii_digits(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def dimension_product(c: Column, pattern: str = vocab.DIMENSIONS_PATTERN) -> Column:
    """Area from the first ``A x B`` in a text."""
    text = ascii_digits(c)
    a = F.regexp_extract(text, pattern, 1).try_cast("double")
    b = F.regexp_extract(text, pattern, 2).try_cast("double")
    return a * b
