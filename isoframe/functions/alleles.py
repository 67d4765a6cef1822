"""Allele spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shared(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning of a and b, at most ``most``."""
    step = lambda n, k: F.when((n == k - 1) & (a.substr(k, F.lit(1)) == b.substr(k, F.lit(1))), k).otherwise(n)
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), step)).otherwise(0)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """Struct (pos, ref, alt) in one spelling: upper case, common end and then beginning cut, one base kept.

    Single-base alleles are left as they are, which skips the work for most records.
    """
    pair = lambda r, a: F.struct(r.alias("r"), a.alias("a"))
    most = lambda v: F.least(F.length(v["r"]), F.length(v["a"])) - 1

    def without_tail(v: Column) -> Column:
        tail = _bound(pair(F.reverse(v["r"]), F.reverse(v["a"])), lambda w: _shared(w["r"], w["a"], most(w)))
        return _bound(tail, lambda n: pair(v["r"].substr(F.lit(1), F.length(v["r"]) - n), v["a"].substr(F.lit(1), F.length(v["a"]) - n)))

    def without_head(v: Column) -> Column:
        rest = lambda x, n: x.substr(n + 1, F.length(x))
        return _bound(_shared(v["r"], v["a"], most(v)), lambda n: F.struct((pos + n).cast("long").alias("pos"), rest(v["r"], n).alias("ref"), rest(v["a"], n).alias("alt")))

    cut = _bound(pair(F.upper(ref), F.upper(alt)), lambda v: _bound(without_tail(v), without_head))
    plain = F.struct(pos.cast("long").alias("pos"), F.upper(ref).alias("ref"), F.upper(alt).alias("alt"))
    return F.when((F.length(ref) > 1) & (F.length(alt) > 1), cut).otherwise(plain)


def parsed_key(key: Column) -> Column:
    """Struct (pos, ref, alt) of assembly:contig:pos:ref>alt; null where the key is malformed."""
    part = F.split(key, ":")
    pos, change = F.try_element_at(part, F.lit(3)).try_cast("long"), F.try_element_at(part, F.lit(4))
    ref, alt = F.substring_index(change, ">", 1), F.substring_index(change, ">", -1)
    return F.when((F.size(part) == 4) & pos.isNotNull() & change.contains(">"), F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt")))
