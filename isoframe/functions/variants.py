"""Names, places and consequences of variants as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions and consequences by the names that inputs give them.
REGIONS = {
    "coding": "coding", "cds": "coding", "exon": "coding", "promoter": "promoter", "upstream": "promoter", "intergenic": "intergenic",
    "noncoding": "intergenic", "rrna": "rrna", "rna": "rrna",
}
CONSEQUENCES = {
    "missense": "missense", "missense_variant": "missense", "nonsynonymous": "missense", "non_synonymous": "missense", "synonymous": "synonymous",
    "silent": "synonymous", "synonymous_variant": "synonymous", "nonsense": "nonsense", "stop_gained": "nonsense", "stop": "nonsense",
    "frameshift": "frameshift", "frameshift_variant": "frameshift", "inframe_deletion": "inframe_indel", "inframe_insertion": "inframe_indel",
    "inframe": "inframe_indel", "upstream": "upstream", "upstream_gene_variant": "upstream", "rrna": "rrna", "rrna_variant": "rrna",
    "feature_ablation": "deletion", "gene_deletion": "deletion",
}
TRUNCATING = ("nonsense", "frameshift", "deletion", "insertion")


def named(value: Column, names: dict[str, str]) -> Column:
    """The name that stands for a value, whatever its case and outer blanks; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(value)))


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def region_of(value: Column, change: Column) -> Column:
    """The named region, else promoter for changes before the start, else coding."""
    return F.coalesce(named(value, REGIONS), F.when(_text(change).rlike("^(c\\.)?-"), "promoter"), F.lit("coding"))


def consequence_of(effect: Column, change: Column, region: Column) -> Column:
    """The named consequence, else what the change's spelling says, in a fixed order of rules."""
    c = _text(change)
    low = F.lower(c)
    head, tail = (F.regexp_extract(c, "^(?:p\\.)?([A-Za-z][^0-9]*)[0-9]+([^0-9]*)$", k) for k in (1, 2))
    long = F.length(F.regexp_replace(c, "^p\\.", "")) >= 3
    said = (
        F.when(low.contains("fs") | low.contains("frameshift"), "frameshift").when(low.contains("stop") | c.endswith("*"), "nonsense")
        .when(low.rlike("del|ins|dup"), "inframe_indel").when(region == "rrna", "rrna").when(region.isin("promoter", "intergenic") | c.rlike("^(c\\.)?-"), "upstream")
        .when(long & (head != "") & (tail != "") & (F.upper(head) == F.upper(tail)), "synonymous").when(long & (head != "") & tail.rlike("^[A-Za-z]+$"), "missense").otherwise("unknown")
    )
    return F.coalesce(named(effect, CONSEQUENCES), said)


def is_protein_change(change: Column) -> Column:
    """Whether a change is spelled in protein notation."""
    c = F.trim(change)
    return F.when(c.rlike("^(c\\.|n\\.|g\\.|-)"), False).otherwise(c.startswith("p.") | F.lower(c).rlike("stop|fs|del|ins|dup|\\*") | c.rlike("^[A-Z].*[0-9]"))


def _change(pos: Column, ref: Column, alt: Column, hgvs_c: Column, hgvs_p: Column) -> Column:
    filled = lambda x: F.nullif(x, F.lit(""))
    placed = F.when(is_placed(pos, ref, alt), F.concat(ref, pos.cast("string"), alt))
    return F.coalesce(filled(hgvs_p), filled(hgvs_c), placed, F.lit("unknown"))


def is_placed(pos: Column, ref: Column, alt: Column) -> Column:
    return pos.isNotNull() & (F.coalesce(ref, F.lit("")) != "") & (F.coalesce(alt, F.lit("")) != "")


def coordinate_key(assembly: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """assembly:contig:pos:ref>alt; null where the place is not known."""
    place = F.concat_ws(":", assembly, F.coalesce(F.nullif(chrom, F.lit("")), F.lit(".")), pos.cast("string"), F.concat(ref, F.lit(">"), alt))
    return F.when(is_placed(pos, ref, alt), place)


def variant_key(assembly: Column, gene: Column, chrom: Column, pos: Column, ref: Column, alt: Column, hgvs_c: Column, hgvs_p: Column) -> Column:
    """Coordinates where they are known, else a name that says they are not."""
    return F.coalesce(coordinate_key(assembly, chrom, pos, ref, alt), F.concat_ws(":", F.lit("unresolved"), assembly, gene, _change(pos, ref, alt, hgvs_c, hgvs_p)))


def variant_label(gene: Column, pos: Column, ref: Column, alt: Column, hgvs_c: Column, hgvs_p: Column) -> Column:
    """gene_change, for display; no key across tools."""
    return F.concat_ws("_", gene, _change(pos, ref, alt, hgvs_c, hgvs_p))


def locus_of(label: Column) -> Column:
    """Text of a label before its first underscore."""
    return F.substring_index(label, "_", 1)


def grade_weight(grade: Column) -> Column:
    """Ordinal 1 (associated) to 5 of a grade text, null for others."""
    n = F.regexp_extract(_text(grade), "^([1-5])\\)", 1)
    return F.nullif(n, F.lit("")).cast("int")


def cohort_tier(errors: Column, study: Column) -> Column:
    """A with a source study, B without one or while it is pending, null for rows with errors."""
    s = F.lower(_text(study))
    return F.when(_text(errors) != "", F.lit(None)).when((s == "") | s.startswith("pending"), "B").otherwise("A")


def confirms_country(place: Column, country: Column) -> Column:
    """Whether a controlled place field starts with the country; a blank one never confirms."""
    return (_text(place) != "") & (_text(country) != "") & F.lower(_text(place)).startswith(F.lower(_text(country)))


def percent(value: Column) -> Column:
    """A number as per cent: values up to 1 are shares; text that is no number is null."""
    v = F.regexp_replace(value.cast("string"), "%\\s*$", "").try_cast("double")
    return F.when(F.abs(v) <= 1, v * 100).otherwise(v)


def site_of(dotted: Column) -> Column:
    """The second part of site.<id>.…, null for other ids."""
    return F.when(dotted.startswith("site."), F.nullif(F.split_part(dotted, F.lit("."), F.lit(2)), F.lit("")))
