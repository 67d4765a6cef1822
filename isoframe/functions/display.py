"""Texts shown to readers: tokens as words, shares as percentages, the first value given under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: words written in capitals.
ACRONYMS = ("mic", "vme", "me", "ppv", "npv", "qc", "dst", "vcf", "bed", "who", "ntm", "mtbc", "tss", "hgvs", "snv", "mnv", "id", "url", "json", "tsv", "csv", "ci", "ml", "rna", "dna", "atp", "hth")


def filled(text: Column) -> Column:
    """The trimmed text, null where it is blank."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def readable(token: Column) -> Column:
    """``some_internalName`` as ``Some internal name``; null and blank give null, text without words stays.

    A capital after a small letter or a digit begins a word. Capitals of up to five
    letters are codes and stay, as do words with a capital inside.
    """
    words = F.filter(F.split(F.regexp_replace(F.trim(token), "([a-z0-9])([A-Z])", "$1 $2"), r"[\s_\-./]+"), lambda w: w != "")

    def written(word: Column, place: Column) -> Column:
        head, rest = F.substring(word, 1, 1), word.substr(F.lit(2), F.length(word))
        capitals = (word == F.upper(word)) & (word != F.lower(word))
        first = F.concat(F.upper(head), F.when(capitals, F.lower(rest)).otherwise(rest))
        later = F.when(rest != F.lower(rest), word).otherwise(F.lower(word))
        return F.when(F.lower(word).isin(*ACRONYMS), F.upper(word)).when(capitals & (F.length(word) <= 5), word).when(place == 0, first).otherwise(later)

    return F.when(F.size(words) > 0, F.array_join(F.transform(words, written), " ")).otherwise(filled(token))


def readable_all(tokens: Column) -> Column:
    """The tokens of an array as readable text with commas; null where none is left."""
    return F.nullif(F.array_join(F.filter(F.transform(tokens, readable), lambda t: t.isNotNull()), ", "), F.lit(""))


def variant_name(label: Column) -> Column:
    """The label with its first underscore opened up; null where blank."""
    return F.regexp_replace(filled(label), "^([^_]*)_", "$1 ")


def percent(value: Column) -> Column:
    """A share (up to 1) or a percentage as percentage to two places; what is no number gives null."""
    number = value.cast("string").try_cast("double")
    number = F.when(~F.isnan(number), number)
    return F.round(F.when(number <= 1, number * 100).otherwise(number), 2)


def whole(value: Column) -> Column:
    """The value as a long; what is no whole number gives null, never 0."""
    return filled(value).try_cast("long")


def given(df: DataFrame, *names: str) -> Column:
    """The first filled value, as text, of those of the named columns that the table has."""
    held = [filled(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def shown(df: DataFrame, default: str, *names: str) -> Column:
    """``given``, readable, or the default text."""
    return F.coalesce(readable(given(df, *names)), F.lit(default))
