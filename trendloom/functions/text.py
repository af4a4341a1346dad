"""Cleaning, keys, tokens and labels as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.vocabulary import DASHES, GENERIC_LABEL_WORDS, TURKISH_LETTERS, WEAK_LABELS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def stable_id(*fields: Column | str) -> Column:
    """SHA-1 of the fields joined by '|'; null counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(_c(f).cast("string"), F.lit("")) for f in fields]))


def repair_breaks(t: Column | str) -> Column:
    """Joins words hyphenated over a line break, makes line breaks blanks, squeezes blanks, trims; null is empty."""
    joined = F.regexp_replace(F.coalesce(_c(t), F.lit("")), r"([A-Za-z0-9_])-[ \t]*\n\s*([A-Za-z0-9_])", "$1$2")
    return squeeze(F.regexp_replace(joined, r"[\r\n]+", " "))


def squeeze(t: Column | str) -> Column:
    """Runs of white space are one blank; trimmed."""
    return F.trim(F.regexp_replace(_c(t), r"\s+", " "))


def nfkc(t: Column | str) -> Column:
    """P5: Unicode compatibility composition, for which there is no built-in."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return compose(_c(t))


def repair_encoding(t: Column | str) -> Column:
    """Text decoded by the wrong encoding put right, if the optional ftfy library is installed; else t as it is."""
    try:
        import ftfy
    except ImportError:
        return _c(t)

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else ftfy.fix_text(x))

    return fix(_c(t))


def unify_dashes(t: Column | str) -> Column:
    """P5: six dashes become '-', tabs and no-break spaces blanks."""
    return F.translate(_c(t), DASHES + "\t ", "-" * len(DASHES) + "  ")


def clean(t: Column | str, compose: bool = True) -> Column:
    """P3 to P5 in order."""
    return repair_breaks(unify_dashes(nfkc(repair_encoding(t)) if compose else _c(t)))


def foreign_letters(t: Column | str, letters: str = TURKISH_LETTERS) -> Column:
    """How many characters are of ``letters``; 0 for null."""
    t = F.coalesce(_c(t), F.lit(""))
    return F.length(t) - F.length(F.translate(t, letters, ""))


def parse_year(t: Column | str) -> Column:
    """An integer, also from '2001.0'; 0 if it can't be read."""
    return F.coalesce(_c(t).cast("string").try_cast("double").try_cast("int"), F.lit(0))


def collision_key(t: Column | str) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(t)), "[^a-z0-9]+", " "))


def slug(uri: Column | str) -> Column:
    """The last segment of a path, underscores as blanks."""
    return F.translate(F.element_at(F.split(_c(uri), "/"), -1), "_", " ")


def is_english(lang: Column | str) -> Column:
    """Whether a literal's language tag is absent or English."""
    low = F.lower(_c(lang))
    return low.isNull() | low.isin("", "en", "eng") | low.startswith("en-")


def unigrams(t: Column | str, stop: list[str] = ()) -> Column:
    """Distinct tokens [a-z][a-z0-9_-]{2,} of the lower-cased text without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(t), F.lit(""))), F.lit("([a-z][a-z0-9_-]{2,})"), 1))
    return F.array_except(found, _words(list(stop))) if stop else found


def coherence_tokens(t: Column | str) -> Column:
    """Runs of letters and digits, joined by single hyphens or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(t), F.lit(""))), F.lit("([a-z0-9]+(?:[-_][a-z0-9]+)*)"), 1)


def words_of(t: Column | str, stop: list[str] = ()) -> Column:
    """Words of two characters or more, lower-cased, without stop words."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(_c(t), F.lit(""))), F.lit("([a-z0-9_]{2,})"), 1)
    return F.filter(ws, lambda w: ~w.isin(list(stop))) if stop else ws


def grams_of(ws: Column | str, longest: int = 2) -> Column:
    """1- to n-grams of an array of words; as it is read several times, best a column and no expression."""
    out = grams = ws = _c(ws)
    for n in range(2, longest + 1):
        # Each n-gram is an (n-1)-gram and the word n - 1 places on; arrays are zipped, not sliced for each place.
        size = F.greatest(F.size(ws) - n + 1, F.lit(0))
        grams = F.zip_with(F.slice(grams, 1, size), F.slice(ws, n, size), lambda g, w: F.concat(g, F.lit(" "), w))
        out = F.concat(out, grams)
    return out


def terms(t: Column | str, stop: list[str] = (), longest: int = 2) -> Column:
    """grams_of() the words_of() a text."""
    return grams_of(words_of(t, stop), longest)


def parse_list(t: Column | str) -> Column:
    """T5: a list written as JSON, as a Python list, tuple, set or dictionary (its keys), or with ';', '|' or ',' between; trimmed, distinct, in order."""
    s = F.trim(F.coalesce(_c(t), F.lit("")))
    bracketed = F.regexp_like(s, F.lit(r"^[\[{(](?s:.*)[\])}]$"))
    as_json = F.from_json(F.when(bracketed, F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[({]", "["), r"[)}]$", "]"), "'", '"')), "array<string>")
    as_keys = F.map_keys(F.from_json(F.when(s.startswith("{"), F.regexp_replace(s, "'", '"')), "map<string,string>"))
    by = F.when(s.contains(";"), F.split(s, ";")).when(s.contains("|"), F.split(s, r"\|")).when(s.contains(","), F.split(s, ",")).otherwise(F.array(s))
    items = F.coalesce(F.when(s.startswith("{"), as_keys), F.when(bracketed, as_json), by)
    tidy = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))
    return F.when((s == "") | F.lower(s).isin("nan", "none", "null"), F.array().cast("array<string>")).otherwise(tidy)


def parse_keywords(t: Column | str, top: int = 20) -> Column:
    """Keywords split at ',', ';' and line breaks, brackets and quotes off, lower-cased, distinct, the first ``top``."""
    parts = F.split(F.lower(F.coalesce(_c(t), F.lit(""))), "[,;\\n]")
    tidy = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "^[^a-z0-9]+|[\\]\\)'\"\\s]+$", "")))
    return F.slice(F.array_distinct(F.filter(tidy, lambda x: x != "")), 1, top)


def label_tokens(label: Column | str) -> Column:
    """Words of a label, lower-cased: runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(label), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def is_weak_label(label: Column | str, generic: list[str] = GENERIC_LABEL_WORDS, tokens: Column | str | None = None) -> Column:
    """Empty, a filler, one short or generic word, or two generic words.

    Of long texts, their label_tokens() best come as a column, as they are read several times.
    Fillers are single words, so that only labels of one word are cleaned to compare them.
    """
    ts = label_tokens(label) if tokens is None else _c(tokens)
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(label), F.lit(""))), r"[^a-z0-9\s/_\-]+", " "))
    n = F.size(ts)
    all_generic = F.forall(ts, lambda t: t.isin(generic))
    return F.when(n > 2, False).when(n == 0, True).when(n == 2, all_generic).otherwise(low.isin(WEAK_LABELS) | all_generic | (F.length(F.element_at(ts, 1)) < 4))


def label_from_keywords(kws: Column | str, most: int = 3, relative: float = 0.35, generic: list[str] = GENERIC_LABEL_WORDS) -> Column:
    """A label of array<struct<term, weight>> in falling weight.

    The first ``most`` terms that aren't short, generic or under ``relative`` of the top weight
    (the first one left may be), joined by ' / '; without any, the first terms as they are.
    """
    kws = _c(kws)
    top = F.coalesce(F.get(kws, F.lit(0))["weight"], F.lit(0.0))
    fine = F.filter(kws, lambda k: (F.length(F.trim(k["term"])) >= 3) & ~F.lower(F.trim(k["term"])).isin(generic))
    heavy = F.filter(fine, lambda k, i: (i == 0) | (top <= 0) | (k["weight"] >= relative * top))
    names = lambda xs: F.array_join(F.slice(F.transform(xs, lambda k: F.trim(k["term"])), 1, most), " / ")
    return F.when(F.size(heavy) > 0, names(heavy)).otherwise(names(kws))


def rescue_tokens(kws: Column | str, drop: list[str]) -> Column:
    """Usable single words of a ';'-joined keyword string, in order, repeats kept."""
    parts = F.flatten(F.transform(F.split(F.lower(F.coalesce(_c(kws), F.lit(""))), ";"), lambda p: F.split(F.trim(p), r"[\s/_\-]+")))
    tidy = F.transform(parts, lambda w: F.regexp_replace(w, r"[^a-z0-9_\-]+", ""))
    return F.filter(tidy, lambda w: (F.length(w) >= 3) & ~w.isin(drop) & ~F.regexp_like(w, F.lit("^[0-9]+$")))


def strip_fences(t: Column | str) -> Column:
    """Code fences off."""
    return F.trim(F.regexp_replace(F.coalesce(_c(t), F.lit("")), "(?i)```(json)?", ""))


def clean_label(t: Column | str) -> Column:
    """Numbering, a 'Topic:' or 'Label:' before it, quotes and surplus blanks off; empty becomes 'Outlier'."""
    s = strip_fences(t)
    s = F.regexp_replace(s, r"^\s*\d+\s*[.:)]\s*", "")
    s = F.regexp_replace(s, r"(?i)^\s*(topic|label)\s*[:\-]\s*", "")
    s = squeeze(F.regexp_replace(s, "^[\\s'\"`]+|[\\s'\"`]+$", ""))
    return F.when(s == "", "Outlier").otherwise(s)


def quotes(doc: Column | str, quote: Column | str, fold_case: bool = False) -> Column:
    """Whether the quote stands in the document, white space aside; an empty quote always does."""
    a, b = squeeze(F.coalesce(_c(doc), F.lit(""))), squeeze(F.coalesce(_c(quote), F.lit("")))
    return F.lower(a).contains(F.lower(b)) if fold_case else a.contains(b)
