"""Scans and long tables on hand-made rows."""

import gzip

from pyspark.sql import functions as F

from isoframe.functions import alleles
from isoframe.operators import coverage
from isoframe.sources import annotated, vcf


def _trim(pos, ref, alt):
    ref, alt = ref.upper(), alt.upper()
    if min(len(ref), len(alt)) > 1:
        end = 0
        while end < min(len(ref), len(alt)) - 1 and ref[-1 - end] == alt[-1 - end]:
            end += 1
        ref, alt = ref[: len(ref) - end], alt[: len(alt) - end]
        start = 0
        while start < min(len(ref), len(alt)) - 1 and ref[start] == alt[start]:
            start += 1
        pos, ref, alt = pos + start, ref[start:], alt[start:]
    return pos, ref, alt


def test_trim(spark):
    rows = [(10, "A", "T"), (10, "CAG", "CAT"), (10, "cag", "CTG"), (10, "AAA", "AA"), (10, "AC", "ACC"), (10, "GATT", "GATT"), (10, "T", "TCC")]
    df = spark.createDataFrame(rows, "pos long, ref string, alt string")
    got = [tuple(r.t) for r in df.select(alleles.trimmed(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).collect()]
    assert got == [_trim(*r) for r in rows]


def test_keys(spark):
    df = spark.createDataFrame([("a:c:5:A>T",), ("a:c:x:A>T",), ("a:c:5",), (None,)], "k string")
    assert [r.t and tuple(r.t) for r in df.select(alleles.parsed_key(F.col("k")).alias("t")).collect()] == [(5, "A", "T"), None, None, None]


def _scan(spark, tmp_path, prefilter):
    body = [
        "##meta", "#CHROM\tPOS", "chr\t5\t.\tA\tT\t.\tPASS\t.\tGT:DP\t1/1:9", "chr\t6\t.\tA\tT,C\t.\t.\t.\tGT\t0/2", "chr\t7\t.\tA\tT\t.\tLow\t.\tGT\t1/1", "chr\t8\t.\tA\tT\t.\tPASS\t.\tGT\t./.",
        "chr\tx\t.\tA\tT\t.\tPASS\t.\tGT\t1/1", "chr\t9\t.\tCAG\tCAT\t.\tPASS\t.\tGT\t0/0", "chr\t20\t.\tA\t<DEL>\t.\tPASS\t.\tGT\t1/1", "chr\t21\t.\tA\tT\t.\tPASS\t.\tGT\t0/3", "chr\t22\t.\tA\tT\t.\tPASS\t.\tGT\t1\t1", "chr\t5\t.\tA\tG",
    ]
    path = str(tmp_path / f"one{prefilter}.vcf.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join(body) + "\n")
    catalogue = spark.createDataFrame([(5, "A", "T", "v1"), (5, "A", "T", "v1b"), (6, "A", "C", "v2"), (11, "G", "T", "v3"), (7, "A", "T", "v4"), (5, "A", "G", "v5")], "pos long, ref string, alt string, label string")
    text = vcf.lines(spark, path)
    rows = vcf.alleles(vcf.candidates(text, catalogue) if prefilter else vcf.sites(text))
    return {r.label: r.carried for r in vcf.matched(rows, catalogue).collect()}, {(r.pos, r.alt): r.status for r in rows.collect()}


def test_scan_with_and_without_prefilter(spark, tmp_path):
    found, _ = _scan(spark, tmp_path, True)
    plain, status = _scan(spark, tmp_path, False)
    assert found == plain == {"v1": True, "v1b": True, "v2": True, "v3": False, "v5": True}
    assert status[7, "T"] == status[8, "T"] == "filtered" and status[21, "T"] == status[22, "T"] == "error" and (20, "<DEL>") not in status


def test_interval_join_equals_all_pairs(spark):
    a = spark.range(60).select(F.lit("c").alias("k"), F.col("id").alias("i"), (F.col("id") * 37 % 500).alias("start"), (F.col("id") * 37 % 500 + F.col("id") % 9 * 30).alias("end"))
    b = spark.range(40).select(F.lit("c").alias("k"), F.col("id").alias("j"), (F.col("id") * 53 % 500).alias("start"), (F.col("id") * 53 % 500 + 25).alias("end"))
    got = sorted((r.i_a, r.j_b) for r in coverage.interval_join(a, b, ["k"], 40).collect())
    assert got == sorted((x.i, y.j) for x in a.collect() for y in b.collect() if x.start < x.end and x.start < y.end and y.start < x.end)


def test_unknown_coverage_is_not_callable(spark):
    df = spark.createDataFrame([(None, 50), (0.99, None), (0.99, 5), (0.5, 50)], "callable_fraction double, mean_depth int")
    assert [r.ok for r in df.select(coverage.is_callable().alias("ok")).collect()] == [False, True, False, False]


def test_annotated_records_are_parsed_once(spark):
    head, record = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS", lambda alt, info="GENE=g;AF=0.2,0.4": f"c\t5\t.\tA\t{alt}\t50\tPASS\t{info}"
    lines = [("f", head), ("f", record("T,<DUP>,*")), ("f", record("T, G")), ("f", record("")), ("f", record("T", "SVTYPE=DEL")), ("f", "c\t5"), ("bare", record("T")), ("bare", record("G")), ("open", "##x=1"), ("open", record("T"))]
    found, rejects = annotated.load(spark.createDataFrame(lines, "file string, value string"))
    assert sorted((r.file, r.reason) for r in rejects.collect()) == [("bare", "no header"), *[("f", x) for x in ("fewer than 8 columns", "no alternate allele", "structural without gene", "symbolic allele", "symbolic allele")], ("open", "no header")]
    assert sorted((r.alt, r.vaf) for r in found.collect()) == [("G", 0.4), ("T", 0.2), ("T", 0.2)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found, rejects)]
    assert [p.count("map_from_entries") for p in plans] == [1, 1]
    assert not any("split(" in line for p in plans for line in p.split("\n") if "Generate explode" in line)


def test_loaded_baselines_are_listed_and_counted(spark):
    """Every baseline with the number of those equal to it, from which the counts of distinct ones follow."""
    from collections import Counter

    from isoframe.plans import streams

    rows = streams.loaded_baselines(spark, "/root/testdata/sf0.001").collect()
    alike = Counter((r.drug, r.base_coverage, r.base_risk) for r in rows)
    assert rows and all(r.n == alike[r.drug, r.base_coverage, r.base_risk] for r in rows) and max(alike.values()) > 1
