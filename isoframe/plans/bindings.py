"""Domain tables as fixed projections of the given tables, in SQL that several engines read alike."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.operators.joins import spread

TABLES = "region nation customer supplier part orders lineitem events".split()
#: The keys by which the large tables of an order meet.
JOINED_BY = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}

BINDINGS = {
    "calls": """
SELECT l_orderkey * 10 + l_linenumber AS sample_id, o_orderpriority AS drug,
  CASE l_returnflag WHEN 'R' THEN 'resistant' WHEN 'A' THEN 'susceptible' ELSE 'not_assessed' END AS call_a,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'resistant' ELSE 'susceptible' END AS call_b,
  CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'S' END AS phenotype,
  NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage, n_regionkey AS site_id, ROUND(l_discount * 10, 1) AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "isolates": """
SELECT c_custkey AS isolate_id, n_regionkey AS site_id, NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "carriage": """
SELECT DISTINCT o_custkey AS isolate_id, CONCAT('g', CAST(l_partkey % 50 % 10 AS VARCHAR(9)), '_v', CAST(l_partkey % 50 AS VARCHAR(9))) AS label
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "raw_mic": """
SELECT o_custkey AS isolate_id, o_orderpriority AS drug,
  CASE WHEN MAX(o_orderkey) % 9 - 4 <= -2 THEN '<=0.25' WHEN MAX(o_orderkey) % 9 - 4 >= 3 THEN '>4'
    WHEN MAX(o_orderkey) % 9 = 3 THEN '0.5' WHEN MAX(o_orderkey) % 9 = 4 THEN '1' WHEN MAX(o_orderkey) % 9 = 5 THEN ' 2 ' ELSE 'NA' END AS mic
FROM orders GROUP BY o_custkey, o_orderpriority""",
    "coverage": """
SELECT o_custkey AS isolate_id, p_brand AS locus, CAST(FLOOR(SUM(l_quantity)) AS BIGINT) AS mean_depth,
  SUM(CASE WHEN l_discount > 0.01 THEN 1.0 ELSE 0.0 END) / COUNT(*) AS callable_fraction
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand""",
    "observations": """
SELECT o_orderkey AS arrival, o_custkey AS isolate_id, n_regionkey AS site_id, o_orderpriority AS drug,
  CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'S' END AS phenotype, NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage, CASE WHEN o_orderkey % 5 > 0 THEN l_partkey END AS variant
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "cohort": """
SELECT o_orderkey AS sample_id, CONCAT('P', CAST(o_custkey % 9 % 5 AS VARCHAR(9))) AS project, o_orderpriority AS tier,
  o_orderstatus AS organism, CAST(FLOOR(o_totalprice) AS BIGINT) AS bases FROM orders""",
    "pvalues": """
SELECT p_partkey AS pair_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 37 % 1009) / 40000.0 END AS p FROM part""",
    "site_calls": """
SELECT l_partkey AS variant, p_type AS drug, s_nationkey AS site_id,
  CASE l_returnflag WHEN 'R' THEN 'resistant' WHEN 'A' THEN 'susceptible' ELSE 'indeterminate' END AS call,
  CASE s_suppkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS version
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "vcf": """
SELECT CAST(o_custkey AS VARCHAR(9)) AS file, l_partkey % 200 + 1 AS pos, l_linenumber % 3 AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CAG' ELSE 'g' END AS ref, CASE l_linenumber % 3 WHEN 0 THEN 'T,<DEL>' WHEN 1 THEN 'CAT,CTG' ELSE 'c' END AS alt,
  CASE WHEN l_tax = 0.01 THEN 'LowQual' ELSE 'PASS' END AS filter,
  CASE WHEN l_discount = 0.05 THEN './.' WHEN l_returnflag = 'R' THEN '1/1' WHEN l_returnflag = 'A' THEN '0|2' ELSE '0/0' END AS gt
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "coordinates": """
SELECT DISTINCT p_partkey % 60 + 1 + CASE p_partkey % 60 % 3 WHEN 1 THEN 2 ELSE 0 END AS pos, CASE p_partkey % 60 % 3 WHEN 0 THEN 'A' ELSE 'G' END AS ref,
  CASE p_partkey % 60 % 3 WHEN 2 THEN 'C' ELSE 'T' END AS alt, CONCAT('m', CAST(p_partkey % 60 AS VARCHAR(9))) AS label FROM part""",
    "profile": "SELECT DISTINCT p_type AS drug, CASE WHEN p_type NOT LIKE 'PROMO%' THEN p_brand END AS locus FROM part",
    "scopes": """
SELECT DISTINCT p_type AS drug, CASE p_size % 3 WHEN 0 THEN 'e0' WHEN 1 THEN 'e1' ELSE 'catalogue' END AS engine,
  CASE p_size % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS organism FROM part""",
    "contexts": "SELECT c_custkey AS isolate_id, c_mktsegment AS organism FROM customer",
    "qc": """
SELECT c_custkey AS isolate_id, 'species_confirmation' AS qc_check, CASE WHEN c_custkey % 6 = 0 THEN 'warn' ELSE 'pass' END AS status FROM customer
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'duplication' ELSE 'contamination' END, CASE WHEN c_acctbal < 0 THEN 'fail' ELSE 'pass' END FROM customer""",
    "evidence": """
SELECT o_custkey AS isolate_id, p_type AS drug, CASE WHEN l_returnflag = 'R' THEN 'resistant' WHEN l_returnflag = 'A' THEN 'susceptible' WHEN l_linenumber % 2 = 0 THEN 'indeterminate' ELSE 'no_call' END AS call,
  CASE WHEN l_linenumber = 1 THEN 'phenotypic' ELSE 'catalogued' END AS tier, CASE WHEN l_quantity > 25 THEN 'isolate' ELSE 'variant' END AS scope, l_discount > 0.05 AS asserts_coverage,
  CONCAT('e', CAST(l_linenumber % 3 AS VARCHAR(9))) AS engine
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "blocks": """
SELECT CAST(l_partkey % 5 AS VARCHAR(9)) AS chrom, l_orderkey AS block_id, l_partkey * 10 AS start, l_partkey * 10 + CAST(FLOOR(l_quantity) AS BIGINT) * 7 AS stop, l_linenumber * 5 AS depth FROM lineitem""",
    "spans": "SELECT CAST(p_partkey % 5 AS VARCHAR(9)) AS chrom, p_partkey AS locus, p_partkey * 10 AS start, p_partkey * 10 + p_size * 20 AS stop FROM part",
    "determinants": "SELECT DISTINCT o_orderpriority AS drug, CONCAT('g', CAST(l_partkey % 50 % 10 AS VARCHAR(9)), '_v', CAST(l_partkey % 50 AS VARCHAR(9))) AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 50 < 2 AND o_orderpriority < '3'",
    "graded": """
SELECT DISTINCT CONCAT('g', CAST(l_partkey % 50 % 10 AS VARCHAR(9)), '_v', CAST(l_partkey % 50 AS VARCHAR(9))) AS label, o_orderpriority AS drug,
  CASE WHEN l_partkey % 50 < 2 THEN 'resistant' WHEN l_partkey % 50 % 3 = 0 THEN 'not_associated' ELSE 'indeterminate' END AS call FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "findings": """
SELECT l_orderkey AS sample, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS gene, CONCAT('p.A', CAST(l_partkey % 700 AS VARCHAR(9)), 'B') AS change, LOWER(p_type) AS drug, l_discount AS freq, CAST(l_quantity AS BIGINT) AS depth,
  l_linenumber AS k, CASE l_linenumber % 5 WHEN 0 THEN 'Assoc w R' WHEN 1 THEN 'Uncertain significance' WHEN 2 THEN 'Not assoc w R' WHEN 3 THEN 'mystery' END AS grade FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "hits": """
SELECT p_partkey AS hit, CASE WHEN p_partkey % 11 = 4 THEN '' ELSE p_name END AS gene, CASE WHEN p_type = 'PROMO' THEN 'VIRULENCE' ELSE 'AMR' END AS element_type, CASE WHEN p_size % 2 = 0 THEN 'point' ELSE 'AMR' END AS element_subtype,
  CASE WHEN p_size % 7 > 0 THEN p_brand END AS class, CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN ' ' END AS subclass, CASE WHEN p_size % 9 > 0 THEN 80.0 + p_size % 20 END AS identity, CASE WHEN p_size % 8 > 0 THEN 85.0 + p_size % 15 END AS coverage FROM part""",
    "depths": """
SELECT l_orderkey * 10 + l_linenumber AS id, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS locus, CAST(l_quantity AS BIGINT) AS mean_depth, CASE l_linenumber % 3 WHEN 0 THEN l_discount * 11 END AS callable_fraction,
  CASE WHEN l_linenumber % 3 < 2 THEN l_partkey % 120 END AS covered_bp, CASE WHEN l_linenumber % 2 = 0 THEN 100 END AS total_bp FROM lineitem""",
    "regions": "SELECT l_partkey AS locus, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS stop, CASE WHEN l_linenumber > 1 THEN l_linenumber * 7 END AS depth FROM lineitem",
    "changes": """
SELECT p_partkey AS id, CONCAT('g', CAST(p_size % 40 AS VARCHAR(9))) AS gene, CASE WHEN p_size % 4 > 0 THEN p_brand END AS chrom, CASE WHEN p_size % 3 > 0 THEN p_partkey * 3 END AS pos, CASE WHEN p_size % 6 > 0 THEN 'A' ELSE '' END AS ref, 'T' AS alt,
  CASE p_partkey % 12 WHEN 0 THEN 'S315T' WHEN 1 THEN 'p.Ala5Ala' WHEN 2 THEN 'c.-15C>T' WHEN 3 THEN '-12G>A' WHEN 4 THEN 'p.Gly7fs' WHEN 5 THEN 'Q10*' WHEN 6 THEN 'c.100_101del' WHEN 7 THEN 'n.1401A>G' WHEN 8 THEN ' D94G ' WHEN 9 THEN 'A542A' WHEN 10 THEN 'LOF' ELSE '' END AS change,
  CASE p_size % 5 WHEN 0 THEN 'promoter' WHEN 1 THEN 'rRNA' WHEN 2 THEN ' Intergenic' WHEN 3 THEN '' END AS region, CASE p_size % 7 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'Synonymous' WHEN 2 THEN 'weird' END AS effect FROM part""",
    "sheet": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'no run' END AS errors, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Pending review' ELSE 'S1' END AS study, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS place,
  CASE WHEN c_custkey % 6 > 0 THEN (c_custkey % 40) / CAST(20 AS DOUBLE) END AS share, CASE WHEN c_custkey % 3 > 0 THEN CONCAT('site.', CAST(c_custkey % 25 AS VARCHAR(9)), '.x') ELSE CAST(c_custkey AS VARCHAR(9)) END AS dotted,
  CASE c_custkey % 3 WHEN 0 THEN '1) Assoc w R' WHEN 1 THEN '4) Not assoc w R - Interim' ELSE 'other' END AS grade FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "truths": """
SELECT o_custkey AS isolate_id, o_orderpriority AS drug, CASE WHEN MIN(o_orderstatus) = 'F' THEN 'R' ELSE 'S' END AS truth, NULLIF(MAX(c_mktsegment), 'HOUSEHOLD') AS lineage FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, o_orderpriority""",
    "examined": """
SELECT o_custkey AS isolate_id, CONCAT('g', CAST(l_partkey % 50 % 10 AS VARCHAR(9)), '_v', CAST(l_partkey % 50 AS VARCHAR(9))) AS label, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS carried, MAX(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS assessed
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey % 50""",
    "drugs": "SELECT DISTINCT o_orderpriority AS drug FROM orders UNION ALL SELECT DISTINCT p_type FROM part",
    "records": """
SELECT l_orderkey AS file, l_linenumber % 7 AS kind, CONCAT('c', CAST(l_partkey % 3 AS VARCHAR(9))) AS chrom, l_partkey * 10 AS pos, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS gene, CONCAT('S', CAST(l_partkey % 300 AS VARCHAR(9)), 'T') AS change,
  l_discount AS af, CAST(l_quantity AS BIGINT) AS depth, l_partkey % 30 AS ref_depth, l_suppkey % 12 AS alt_depth, CASE WHEN l_tax = 0.01 THEN 'LowQual' ELSE 'PASS' END AS filter FROM lineitem""",
    "variants": """
SELECT l_orderkey AS sample_id, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS gene, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9)), '_c', CAST(l_partkey % 700 AS VARCHAR(9))) AS label,
  CASE WHEN l_linenumber % 2 = 0 THEN CONCAT('k', CAST(l_partkey AS VARCHAR(9))) ELSE CONCAT('unresolved:g', CAST(l_partkey % 40 AS VARCHAR(9)), '_c', CAST(l_partkey % 700 AS VARCHAR(9))) END AS variant_key,
  CASE WHEN l_linenumber % 4 = 0 THEN 'promoter' ELSE 'coding' END AS region, CASE l_partkey % 5 WHEN 0 THEN 'synonymous' WHEN 1 THEN 'frameshift' ELSE 'missense' END AS consequence, CONCAT('c', CAST(l_partkey % 3 AS VARCHAR(9))) AS chrom, l_partkey * 10 AS pos,
  CASE WHEN l_tax < 0.08 THEN l_discount * 10 END AS vaf, CAST(l_quantity AS BIGINT) AS depth, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 20 END AS alt_depth, CASE l_suppkey % 4 WHEN 0 THEN 'illumina' WHEN 1 THEN 'nanopore' WHEN 2 THEN 'other' END AS platform FROM lineitem""",
    "entries": """
SELECT DISTINCT CONCAT('g', CAST(p_partkey % 40 AS VARCHAR(9)), '_c', CAST(p_partkey % 700 AS VARCHAR(9))) AS label, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('k', CAST(p_partkey AS VARCHAR(9))) END AS variant_key, p_type AS drug,
  CASE p_partkey % 4 WHEN 0 THEN 'resistant' WHEN 1 THEN 'not_associated' ELSE 'indeterminate' END AS call FROM part""",
    "regulators": "SELECT DISTINCT CONCAT('g', CAST(p_size % 6 AS VARCHAR(9))) AS gene, p_type AS drug FROM part",
    "promoters": "SELECT DISTINCT CONCAT('g', CAST(p_size % 9 + 4 AS VARCHAR(9))) AS gene, p_type AS drug FROM part",
    "drug_loci": "SELECT DISTINCT CONCAT('g', CAST(p_size % 15 AS VARCHAR(9))) AS gene, p_type AS drug FROM part",
    "areas": """
SELECT p_partkey AS area, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('g', CAST(p_partkey % 40 AS VARCHAR(9)), '_c', CAST(p_partkey % 700 AS VARCHAR(9))) END AS label, CASE WHEN p_partkey % 3 = 1 THEN CONCAT('c', CAST(p_size % 3 AS VARCHAR(9))) END AS chrom,
  CASE WHEN p_partkey % 3 = 1 THEN p_partkey * 9 END AS start, CASE WHEN p_partkey % 3 = 1 THEN p_partkey * 9 + p_size END AS stop, CASE WHEN p_partkey % 3 = 2 THEN CONCAT('g', CAST(p_size % 40 AS VARCHAR(9))) END AS gene FROM part""",
    "escapes": """
SELECT CONCAT('g', CAST(l_partkey % 20 AS VARCHAR(9))) AS gene, p_type AS drug, CONCAT('v', CAST(l_partkey AS VARCHAR(9))) AS variant, CASE WHEN l_partkey % 3 = 0 THEN 'frameshift' ELSE 'missense' END AS consequence, o_custkey AS isolate_id, NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "metadata": """
SELECT c_custkey AS isolate_id, c_custkey * 7 % 113 AS cluster_id, c_custkey * 11 % 97 AS patient_id, c_nationkey AS site_id, CASE WHEN c_custkey * 7 % 113 % 9 = 0 AND c_acctbal < 0 THEN 'development' ELSE 'evaluation' END AS partition FROM customer""",
    "runs": """
SELECT o_orderkey AS run, o_custkey AS custkey, CASE o_custkey % 5 WHEN 0 THEN 'OXFORD' ELSE 'illumina' END AS platform, CASE o_custkey % 7 WHEN 0 THEN 'SINGLE' ELSE 'PAIRED' END AS layout, CASE WHEN o_custkey % 11 > 0 THEN CONCAT('B', CAST(o_orderkey % 997 AS VARCHAR(9))) END AS biosample,
  o_orderpriority AS organism, CASE WHEN o_orderkey % 9 = 0 THEN 'species_mismatch_refused' WHEN o_orderkey % 9 = 1 THEN ' ' END AS outcome, CAST(FLOOR(o_totalprice) AS BIGINT) AS bases FROM orders""",
    "labs": """
SELECT o_orderkey AS observation_id, o_custkey AS isolate_id, o_orderpriority AS drug, CASE o_orderstatus WHEN 'F' THEN 'resistant' WHEN 'O' THEN 'susceptible' ELSE 'indeterminate' END AS result, CASE WHEN o_orderkey % 6 = 0 THEN 'fail' ELSE 'pass' END AS quality,
  CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 60000 END AS mic FROM orders""",
    "calibrations": """
SELECT DISTINCT CASE o_orderkey % 2 WHEN 0 THEN 'illumina' ELSE 'nanopore' END AS platform, o_orderpriority AS drug, CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE CONCAT('L', CAST(o_orderkey % 3 AS VARCHAR(9))) END AS lineage, CAST(o_orderkey % 6 + 1 AS DOUBLE) / 100 AS lod50 FROM orders WHERE o_orderpriority < '4'""",
    "pair_rules": "SELECT p_partkey AS rule, p_type AS drug, CONCAT('g', CAST(p_size % 40 AS VARCHAR(9))) AS primary, CASE WHEN p_partkey % 2 = 0 THEN CONCAT('g', CAST(p_partkey % 40 AS VARCHAR(9))) ELSE CONCAT('k', CAST(p_partkey AS VARCHAR(9))) END AS partner FROM part",
    "results": """
SELECT l_orderkey * 10 + l_linenumber AS sample_id, o_orderpriority AS drug, n_regionkey AS site_id, CASE l_returnflag WHEN 'R' THEN 'resistant' WHEN 'A' THEN 'susceptible' ELSE 'not_assessed' END AS genomic_call,
  CASE o_orderstatus WHEN 'F' THEN 'resistant' WHEN 'O' THEN 'susceptible' END AS phenotypic_call, CASE WHEN o_orderstatus = 'F' THEN 'resistant' WHEN l_returnflag = 'A' THEN 'susceptible' ELSE 'not_assessed' END AS call
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "performance": """
SELECT CONCAT('m', CAST(p_size % 10 AS VARCHAR(9))) AS model, p_brand AS drug, CAST(CASE WHEN COUNT(*) % 5 = 0 THEN 0.7 ELSE 0.8 END AS DOUBLE) AS call_rate, CAST(CASE COUNT(*) % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 WHEN 2 THEN 0.04 ELSE 0.03 END AS DOUBLE) AS error_rate, CAST(0.75 AS DOUBLE) AS base_coverage, CAST(0.05 AS DOUBLE) AS base_error FROM part GROUP BY p_size % 10, p_brand""",
    "arms": """
SELECT o_orderpriority AS drug, NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage, n_regionkey AS site_id, CASE o_orderstatus WHEN 'F' THEN 'resistant' ELSE 'susceptible' END AS truth, CASE l_returnflag WHEN 'R' THEN 'resistant' WHEN 'A' THEN 'susceptible' ELSE 'no_call' END AS baseline_call,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'resistant' ELSE 'susceptible' END AS intervention_call
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "signals": """
SELECT p_brand AS drug, o_custkey AS isolate_id, n_regionkey AS site_id, l_returnflag = 'R' AS resistant, l_linenumber < 4 AS explained, CASE WHEN l_linenumber > 5 THEN CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) END AS gene
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "wide": """
SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 13 = 0 THEN 'NONE' ELSE CONCAT('R', CAST(c_custkey AS VARCHAR(9))) END AS run,
  CASE c_nationkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 's' WHEN 2 THEN '' ELSE 'I' END AS rif_phenotype, CASE c_custkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS rif_quality, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '0.5' END AS rif_mic,
  CASE c_nationkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN ' R ' END AS inh_phenotype, 'high' AS inh_quality, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '>8' END AS inh_mic FROM customer""",
    "stream_rows": """
SELECT CAST(event_id % 7 AS VARCHAR(9)) AS cohort_id, event_type AS drug, CASE user_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'L1' ELSE 'L2' END AS lineage,
  CASE WHEN value < 30 THEN 'resistant' WHEN value < 70 THEN 'Susceptible' ELSE 'not_assessed' END AS predicted, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'R' ELSE 's' END AS phenotype FROM events""",
    "master": """
SELECT DISTINCT CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS gene, CASE WHEN l_partkey % 97 = 5 THEN ' ' ELSE CONCAT('c', CAST(l_partkey % 700 AS VARCHAR(9))) END AS change, o_orderpriority AS drug,
  CASE (l_partkey + o_custkey % 3) % 7 WHEN 0 THEN '1) Assoc w R' WHEN 1 THEN '2) Assoc w R - Interim ' WHEN 2 THEN '3) Uncertain significance' WHEN 3 THEN '4) Not assoc w R - Interim' WHEN 4 THEN '5) not assoc w r' WHEN 5 THEN '3) uncertain significance' ELSE 'other' END AS grade
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "master_rows": """
SELECT l_orderkey * 10 + l_linenumber AS line, CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) AS gene, CASE WHEN l_partkey % 97 = 5 THEN ' ' ELSE CONCAT('c', CAST(l_partkey % 700 AS VARCHAR(9))) END AS change, p_type AS drug,
  CONCAT('w', CAST(l_partkey % 700 AS VARCHAR(9)), '_', CAST(l_suppkey % 3 AS VARCHAR(9))) AS variant, CASE l_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN ' 2' WHEN 2 THEN '3' END AS tier,
  CASE l_suppkey % 6 WHEN 0 THEN '1) Assoc w R' WHEN 1 THEN '3) Uncertain significance' WHEN 2 THEN '4) Not assoc w R - Interim' WHEN 3 THEN '5) Not assoc w R' WHEN 4 THEN '3) uncertain significance' ELSE 'other' END AS grade
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "spellings": """
SELECT p_partkey AS line, CASE WHEN p_partkey % 31 = 4 THEN '' ELSE CONCAT('w', CAST(p_partkey % 700 AS VARCHAR(9)), '_', CAST(p_size % 3 AS VARCHAR(9))) END AS variant, CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'NC_1' END AS chromosome,
  CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE CAST(p_partkey * 3 AS VARCHAR(9)) END AS position, CASE WHEN p_size % 6 = 0 THEN '' ELSE 'A' END AS ref, CASE WHEN p_size % 5 = 0 THEN 'TG' ELSE 'C' END AS alt FROM part""",
    "dated_calls": """
SELECT CAST(YEAR(o_orderdate) AS VARCHAR(9)) AS period, o_orderpriority AS drug, NULLIF(c_mktsegment, 'HOUSEHOLD') AS lineage, CAST(n_regionkey AS VARCHAR(9)) AS site, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'S' END AS phenotype
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "states": """
SELECT c_custkey AS isolate_id, CASE c_custkey % 4 WHEN 0 THEN 'abscessus' WHEN 1 THEN ' ' WHEN 2 THEN 'massiliense' END AS subspecies, CASE WHEN c_custkey % 17 = 5 THEN NULL WHEN c_mktsegment < 'F' THEN 'mabscessus' ELSE 'mtbc' END AS organism,
  CASE c_nationkey % 3 WHEN 0 THEN 'nonfunctional' WHEN 1 THEN 'functional' END AS erm41_status, CASE WHEN c_custkey % 5 < 4 THEN 'wild_type' ELSE 'mutated' END AS rrl_status FROM customer WHERE c_custkey % 23 > 0""",
    "supplied_models": """
SELECT CASE WHEN l_linenumber % 4 = 1 THEN ' ' WHEN l_linenumber % 4 > 1 THEN CONCAT('m', CAST(l_suppkey AS VARCHAR(9))) END AS model, CONCAT('model ', CAST(l_suppkey AS VARCHAR(9))) AS model_id, CASE l_linenumber % 3 WHEN 0 THEN 'v2' WHEN 1 THEN '' END AS version,
  CASE WHEN l_partkey % 9 > 0 THEN LOWER(p_type) END AS drug, CASE l_partkey % 4 WHEN 0 THEN 'lineage_4' WHEN 1 THEN 'mtbc.L2' WHEN 2 THEN ' ' END AS lineage, CASE l_suppkey % 4 WHEN 0 THEN 'errsMore' WHEN 1 THEN 'model_better' WHEN 2 THEN ' ' END AS verdict,
  CASE l_partkey % 6 WHEN 0 THEN '0.95' WHEN 1 THEN '96.5' WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '1' END AS call_rate, l_quantity / 64 AS error_rate, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS VARCHAR(9)) WHEN 1 THEN 'many' END AS n_called,
  CASE l_suppkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'true' WHEN 2 THEN '0' WHEN 3 THEN '1' END AS registry_ready, CASE WHEN l_tax > 0.05 THEN CONCAT('r', CAST(l_linenumber AS VARCHAR(9))) END AS reason FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "supplied_targets": """
SELECT CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE p_name END AS target, CASE WHEN p_partkey % 10 < 6 THEN CONCAT('g', CAST(p_size % 40 AS VARCHAR(9))) END AS gene, CASE p_size % 3 WHEN 0 THEN 'in_vitro-essential' WHEN 1 THEN 'NON' END AS essentiality,
  CASE p_size % 4 WHEN 0 THEN 'knownPocket' WHEN 1 THEN ' ' END AS druggability, CASE p_size % 2 WHEN 0 THEN 'DNA gyrase MIC' END AS human_homology, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('e', CAST(p_partkey AS VARCHAR(9))) END AS rationale FROM part""",
    "audit": """
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CONCAT(event_type, '_Recorded') END AS action, CASE WHEN event_id % 3 = 0 THEN UPPER(event_type) END AS event, CASE WHEN event_id % 4 > 0 THEN CONCAT('u', CAST(user_id AS VARCHAR(9))) ELSE ' ' END AS actor,
  CASE WHEN event_id % 8 = 0 THEN 'r1' END AS reviewer, CASE WHEN event_id % 5 > 0 THEN CONCAT('isolate ', CAST(user_id AS VARCHAR(9))) END AS summary, CASE WHEN event_id % 7 > 0 THEN CONCAT('00', CAST(event_id * 7919 AS VARCHAR(18))) END AS entry_hash FROM events""",
    "structures": """
SELECT CASE WHEN l_linenumber < 7 THEN CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9)), '_c', CAST(l_partkey % 700 AS VARCHAR(9)), '_x') END AS variant, CASE WHEN l_suppkey % 6 > 0 THEN CONCAT('g', CAST(l_partkey % 40 AS VARCHAR(9))) END AS gene, CASE l_suppkey % 3 WHEN 0 THEN 'active_site' WHEN 1 THEN 'drugBinding pocket' END AS location,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 30 END AS ligand_distance, CASE WHEN l_linenumber % 4 = 0 THEN 'A' END AS distance_unit, CASE l_returnflag WHEN 'R' THEN 'validated' WHEN 'A' THEN ' ' END AS status FROM lineitem""",
    "paired": """
SELECT l_orderkey AS sample_id, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS baseline_minutes, l_quantity - l_linenumber AS intervention_minutes,
  l_extendedprice AS baseline_cost, CASE WHEN l_tax = 0.02 THEN NULL ELSE ROUND(l_extendedprice * (1 - l_discount), 2) END AS intervention_cost, CASE l_returnflag WHEN 'R' THEN 'USD' WHEN 'A' THEN 'EUR' END AS currency FROM lineitem""",
}


def order_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of lineitem, which is the largest table: domain tables that join it have at most as many."""
    return spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).count()


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the tables of ``sf_dir``. Tables joined by order and customer are dealt to as many tasks as the order lines need."""
    used = [table for table in TABLES if re.search(rf"\b{table}\b", BINDINGS[name])]
    lines = order_lines(spark, sf_dir) if {"lineitem", "orders"} <= set(used) else 0
    for table in used:
        rows = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
        (spread(rows, lines, JOINED_BY[table]) if table in JOINED_BY else rows).createOrReplaceTempView(table)
    return spark.sql(BINDINGS[name])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_bindings(names: str, query: str) -> str:
    """The query with its domain tables as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names.split()) + query
