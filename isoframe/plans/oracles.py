"""SQL that states the results of the registered queries over the same tables."""

from __future__ import annotations

from isoframe.plans import effect_scan, follow_ups, loads, report_views, shown_views, streams, tool_outputs, variant_lanes
from isoframe.plans.bindings import with_bindings

_COUNTS = """COUNT(*) AS n_evaluable,
  COUNT(CASE WHEN c IN ('resistant', 'susceptible') THEN 1 END) AS n_called, COUNT(CASE WHEN c NOT IN ('resistant', 'susceptible') THEN 1 END) AS n_abstained,
  COUNT(CASE WHEN c = 'resistant' AND phenotype = 'R' THEN 1 END) AS tp, COUNT(CASE WHEN c = 'resistant' AND phenotype = 'S' THEN 1 END) AS fp,
  COUNT(CASE WHEN c = 'susceptible' AND phenotype = 'S' THEN 1 END) AS tn, COUNT(CASE WHEN c = 'susceptible' AND phenotype = 'R' THEN 1 END) AS fn,
  COUNT(CASE WHEN c NOT IN ('resistant', 'susceptible') AND phenotype = 'R' THEN 1 END) AS abstained_r,
  COUNT(CASE WHEN c NOT IN ('resistant', 'susceptible') AND phenotype = 'S' THEN 1 END) AS abstained_s"""
_EVALUABLE = ", e AS (SELECT *, lower(trim(coalesce(call_a, ''))) AS c, coalesce(lineage, 'unknown') AS l FROM calls WHERE phenotype IN ('R', 'S'))"
_RATES = {
    "call_rate": ("n_called", "n_evaluable"), "sensitivity": ("tp", "(tp + fn)"), "specificity": ("tn", "(tn + fp)"),
    "ppv": ("tp", "(tp + fp)"), "npv": ("tn", "(tn + fn)"), "vme_rate": ("fn", "(tp + fn)"), "me_rate": ("fp", "(tn + fp)"),
}
_Z = "1.959963985"


def _rate(name: str) -> str:
    a, b = _RATES[name]
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END)"


def _wilson(name: str) -> str:
    (a, b), p = _RATES[name], _rate(name)
    n = f"CAST({b} AS DOUBLE)"
    centre, margin = f"({p} + {_Z} * {_Z} / (2 * {n}))", f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4 * {n} * {n})))"
    scale = f"(1 + {_Z} * {_Z} / {n})"
    shown = f"n_evaluable >= 20 AND {b} > 0"
    return (
        f"CASE WHEN {shown} THEN round(greatest(0.0, {centre} / {scale} - {margin} / {scale}), 6) + 0.0 END AS {name}_low, "
        f"CASE WHEN {shown} THEN round(least(1.0, {centre} / {scale} + {margin} / {scale}), 6) + 0.0 END AS {name}_high"
    )


_CONCORDANCE = """SELECT drug, COUNT(*) AS n_compared, COUNT(CASE WHEN p AND q AND x = y THEN 1 END) AS agree, COUNT(CASE WHEN p AND q AND x <> y THEN 1 END) AS disagree,
  COUNT(CASE WHEN p AND NOT q THEN 1 END) AS only_a, COUNT(CASE WHEN q AND NOT p THEN 1 END) AS only_b, COUNT(CASE WHEN NOT p AND NOT q THEN 1 END) AS neither,
  CASE WHEN COUNT(CASE WHEN p AND q THEN 1 END) > 0 THEN round(CAST(COUNT(CASE WHEN p AND q AND x = y THEN 1 END) AS DOUBLE) / COUNT(CASE WHEN p AND q THEN 1 END), 6) + 0.0 END AS agreement_rate
FROM (SELECT drug, coalesce(call_a, '') AS x, coalesce(call_b, '') AS y, coalesce(call_a, '') IN ('resistant', 'susceptible') AS p, coalesce(call_b, '') IN ('resistant', 'susceptible') AS q FROM {}) GROUP BY drug"""
_VERDICTS = _EVALUABLE + f""", k AS (SELECT drug, {_COUNTS} FROM e GROUP BY drug),
t(drug, max_vme, max_me, min_call_rate, min_evaluable) AS (VALUES ('1-URGENT', 0.05, 0.02, 0.95, 30), ('2-HIGH', 0.6, 0.55, 0.6, 30), ('3-MEDIUM', 0.55, 0.6, 0.6, 1000000), ('4-NOT SPECIFIED', 0.45, 0.7, 0.6, 20)),
v AS (SELECT k.drug AS drug, n_evaluable, min_evaluable,
  concat_ws('; ', CASE WHEN {_rate('vme_rate')} IS NULL THEN 'VME not estimable' WHEN {_rate('vme_rate')} > max_vme THEN 'VME above bound' END,
    CASE WHEN {_rate('me_rate')} IS NULL THEN 'ME not estimable' WHEN {_rate('me_rate')} > max_me THEN 'ME above bound' END,
    CASE WHEN {_rate('call_rate')} < min_call_rate THEN 'call rate below bound' END) AS r
  FROM k LEFT JOIN t ON k.drug = t.drug),
w AS (SELECT drug, n_evaluable, CASE WHEN min_evaluable IS NULL THEN 'not-targeted' WHEN n_evaluable < min_evaluable THEN 'underpowered' WHEN r LIKE '%bound%' THEN 'fail' ELSE 'pass' END AS verdict, r FROM v)
"""
_PREDICTIONS = """, pr AS (SELECT drug, CASE WHEN call_a <> 'not_assessed' THEN call_a END AS predicted, CASE phenotype WHEN 'R' THEN 'resistant' WHEN 'S' THEN 'susceptible' END AS truth, confidence FROM calls WHERE phenotype IN ('R', 'S'))"""
_CURVE = _PREDICTIONS + """,
lv AS (SELECT drug, confidence AS threshold, COUNT(*) AS n, COUNT(CASE WHEN predicted <> truth THEN 1 END) AS w FROM pr WHERE predicted IS NOT NULL AND confidence IS NOT NULL GROUP BY drug, confidence),
rk AS (SELECT drug, threshold, row_number() OVER (PARTITION BY drug ORDER BY threshold) - 1 AS i, count(*) OVER (PARTITION BY drug) AS m,
  CAST(sum(n) OVER (PARTITION BY drug ORDER BY threshold DESC) AS BIGINT) AS n_covered, CAST(sum(w) OVER (PARTITION BY drug ORDER BY threshold DESC) AS BIGINT) AS n_errors FROM lv),
cv AS (SELECT rk.drug AS drug, threshold, n_total, n_covered, n_errors, CAST(n_covered AS DOUBLE) / n_total AS coverage, CASE WHEN n_covered >= 10 THEN CAST(n_errors AS DOUBLE) / n_covered END AS risk
  FROM rk JOIN (SELECT drug, COUNT(*) AS n_total FROM pr GROUP BY drug) AS tt ON rk.drug = tt.drug WHERE i % greatest(1, m // 49) = 0 OR i = m - 1)
"""
_MIC = """, ps AS (SELECT isolate_id, drug, mic, trim(mic) AS t FROM raw_mic),
pd AS (SELECT isolate_id, drug, mic, CASE WHEN t IN ('', 'NA') THEN NULL WHEN t LIKE '<%' THEN 'left' WHEN t LIKE '>%' THEN 'right' ELSE 'none' END AS censoring,
  CASE WHEN t NOT IN ('', 'NA') THEN TRY_CAST(regexp_replace(t, '^[<>]=?\\s*', '') AS DOUBLE) END AS mic_value FROM ps),
lg AS (SELECT isolate_id, drug, censoring, log2(mic_value) AS b FROM pd WHERE mic_value > 0)
"""
_SHIFT = _MIC + """, lm AS (SELECT lg.*, site_id FROM lg JOIN isolates ON lg.isolate_id = isolates.isolate_id),
lc AS MATERIALIZED (SELECT l.label AS label, lm.*, c.isolate_id IS NOT NULL AS carrier FROM (SELECT DISTINCT label FROM carriage) AS l CROSS JOIN lm LEFT JOIN carriage AS c ON c.isolate_id = lm.isolate_id AND c.label = l.label),
bn AS MATERIALIZED (SELECT label, drug, site_id, carrier, censoring, b, COUNT(*) AS n FROM lc GROUP BY label, drug, site_id, carrier, censoring, b),
pp AS (SELECT a.label AS label, a.drug AS drug, a.site_id AS site_id, a.n * b.n AS w,
  CASE WHEN a.censoring = 'none' AND b.censoring = 'none' THEN sign(a.b - b.b)
    WHEN a.censoring = 'left' AND b.censoring = 'right' AND a.b <= b.b OR a.censoring = 'left' AND b.censoring = 'none' AND a.b < b.b OR a.censoring = 'none' AND b.censoring = 'right' AND a.b <= b.b THEN -1
    WHEN a.censoring = 'right' AND b.censoring = 'left' AND b.b <= a.b OR a.censoring = 'none' AND b.censoring = 'left' AND b.b < a.b OR a.censoring = 'right' AND b.censoring = 'none' AND b.b <= a.b THEN 1 END AS o
  FROM bn AS a JOIN bn AS b ON a.label = b.label AND a.drug = b.drug AND a.site_id = b.site_id WHERE a.carrier AND NOT b.carrier),
sz AS MATERIALIZED (SELECT label, drug, site_id, COUNT(CASE WHEN carrier THEN 1 END) AS n_a, COUNT(CASE WHEN NOT carrier THEN 1 END) AS n_b FROM lc GROUP BY label, drug, site_id HAVING COUNT(CASE WHEN carrier THEN 1 END) > 0),
sm AS MATERIALIZED (SELECT label, drug, site_id, CAST(SUM(w) AS BIGINT) AS n_pairs, CAST(SUM(CASE WHEN o IS NOT NULL THEN w ELSE 0 END) AS BIGINT) AS n_decisive, SUM(o * w) AS net FROM pp GROUP BY label, drug, site_id),
sh AS (SELECT sz.*, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_decisive, 0) AS n_decisive, net,
  CASE WHEN n_a < 5 OR n_b < 5 THEN 'too few observations' WHEN coalesce(n_decisive, 0) = 0 OR n_decisive < 0.3 * n_pairs THEN 'too few decisive pairs' END AS refused
  FROM sz LEFT JOIN sm ON sz.label = sm.label AND sz.drug = sm.drug AND sz.site_id = sm.site_id),
sf AS (SELECT label, drug, site_id, n_a, n_b, n_pairs, n_decisive, refused, CASE WHEN refused IS NULL THEN round(CAST(net AS DOUBLE) / n_decisive, 6) + 0.0 END AS delta FROM sh)
"""

_ALLELES = """, st AS (SELECT *, CASE WHEN filter = 'LowQual' OR gt = './.' THEN 'filtered' WHEN gt = '0|2' AND kind = 2 THEN 'error' ELSE 'ok' END AS status FROM vcf),
al AS (SELECT file, status, gt, pos AS p, 'A' AS r, 'T' AS a, 1 AS i FROM st WHERE kind = 0 UNION ALL SELECT file, status, gt, pos + 2, 'G', 'T', 1 FROM st WHERE kind = 1
  UNION ALL SELECT file, status, gt, pos + 1, 'A', 'T', 2 FROM st WHERE kind = 1 UNION ALL SELECT file, status, gt, pos, 'G', 'C', 1 FROM st WHERE kind = 2),
ac AS (SELECT *, gt = '1/1' AND i = 1 OR gt = '0|2' AND i = 2 AS carried FROM al),
gm AS (SELECT file, label, max(carried) AS carried FROM ac JOIN coordinates AS c ON ac.p = c.pos AND ac.r = c.ref AND ac.a = c.alt WHERE status = 'ok' GROUP BY file, label)
"""
_GATE = """, gt AS (SELECT i.isolate_id AS isolate_id, r.drug AS drug, r.locus AS locus, coalesce(callable_fraction >= 0.75, false) AND coalesce(mean_depth >= 10, true) AS ok
  FROM isolates AS i CROSS JOIN (SELECT DISTINCT drug, locus FROM profile) AS r LEFT JOIN coverage AS c ON c.isolate_id = i.isolate_id AND c.locus = r.locus),
gate AS (SELECT isolate_id, drug, bool_and(ok) AND COUNT(locus) > 0 AS adequate, COUNT(locus) AS n_required, coalesce(string_agg(CASE WHEN NOT ok THEN locus END, ',' ORDER BY locus), '') AS missing FROM gt GROUP BY isolate_id, drug)
"""
_PERMITS = """, ps AS (SELECT isolate_id FROM (SELECT isolate_id, qc_check, bool_and(status = 'pass') AS ok FROM qc WHERE qc_check IN ('species_confirmation', 'contamination') GROUP BY isolate_id, qc_check) WHERE ok GROUP BY isolate_id HAVING COUNT(*) = 2),
pm AS (SELECT DISTINCT c.isolate_id AS isolate_id, drug, engine FROM contexts AS c JOIN ps ON ps.isolate_id = c.isolate_id JOIN scopes AS s ON s.organism = c.organism)
"""
_RECONCILED = _GATE + _PERMITS + """, ev AS (SELECT e.*, CASE tier WHEN 'phenotypic' THEN 4 WHEN 'catalogued' THEN 3 END AS k, pm.engine IS NOT NULL AS allowed, tier <> 'phenotypic' AS gen, call = 'susceptible' AND scope = 'isolate' AS wide
  FROM evidence AS e LEFT JOIN pm ON pm.isolate_id = e.isolate_id AND pm.drug = e.drug AND pm.engine = e.engine),
fx AS (SELECT isolate_id, drug, COUNT(*) AS n, MAX(CASE WHEN gen THEN k END) AS kall, MAX(CASE WHEN gen AND call = 'resistant' THEN k END) AS r, MAX(CASE WHEN gen AND call = 'indeterminate' THEN k END) AS i, MAX(CASE WHEN gen AND call = 'no_call' THEN k END) AS x,
  MAX(CASE WHEN gen AND wide THEN k END) AS w, MAX(CASE WHEN call = 'resistant' THEN k END) AS ar, MAX(CASE WHEN wide THEN k END) AS aw, MAX(CASE WHEN gen AND wide AND asserts_coverage THEN k END) AS s, MAX(CASE WHEN gen AND wide AND asserts_coverage AND allowed THEN k END) AS sp,
  MIN(CASE WHEN tier = 'phenotypic' THEN call END) AS lo, MAX(CASE WHEN tier = 'phenotypic' THEN call END) AS hi FROM ev GROUP BY isolate_id, drug),
gc AS (SELECT gate.isolate_id AS isolate_id, gate.drug AS drug, coalesce(n, 0) AS n, ar IS NOT NULL AND aw IS NOT NULL AS clash,
  CASE WHEN r IS NOT NULL AND w IS NOT NULL THEN 1 WHEN r IS NOT NULL THEN 2 WHEN i IS NOT NULL THEN 3 WHEN x IS NOT NULL THEN 4 WHEN sp IS NOT NULL THEN 5 WHEN NOT adequate AND s IS NULL THEN 6 WHEN adequate AND pm.engine IS NOT NULL THEN 7 ELSE 8 END AS g,
  kall, r, i, x, sp, CASE WHEN lo = hi THEN lo WHEN lo IS NOT NULL THEN 'indeterminate' END AS m
  FROM gate LEFT JOIN fx ON fx.isolate_id = gate.isolate_id AND fx.drug = gate.drug LEFT JOIN pm ON pm.isolate_id = gate.isolate_id AND pm.drug = gate.drug AND pm.engine = 'catalogue'),
gk AS (SELECT *, CASE g WHEN 1 THEN 'indeterminate' WHEN 2 THEN 'resistant' WHEN 3 THEN 'indeterminate' WHEN 4 THEN 'no_call' WHEN 5 THEN 'susceptible' WHEN 6 THEN 'not_assessed' WHEN 7 THEN 'susceptible' ELSE 'indeterminate' END AS gcall,
  CASE g WHEN 1 THEN kall WHEN 2 THEN r WHEN 3 THEN i WHEN 4 THEN x WHEN 5 THEN sp WHEN 7 THEN 3 ELSE 0 END AS k, CASE WHEN g = 1 THEN 'conflict' WHEN g < 5 THEN 'evidence' WHEN g = 5 THEN 'asserted' WHEN g = 6 THEN 'loci' WHEN g = 7 THEN 'catalogue' ELSE 'no scope' END AS why FROM gc),
rc AS (SELECT isolate_id, drug, gcall AS genomic_call, m AS phenotypic_call, CASE WHEN clash OR m NOT IN ('resistant', 'susceptible') THEN 'indeterminate' WHEN m IS NOT NULL THEN m ELSE gcall END AS call,
  CASE CASE WHEN m IN ('resistant', 'susceptible') THEN 4 ELSE k END WHEN 4 THEN 'phenotypic' WHEN 3 THEN 'catalogued' ELSE 'none' END AS tier,
  CASE WHEN clash THEN 'conflict' WHEN m IN ('resistant', 'susceptible') THEN 'phenotype' WHEN m IS NOT NULL THEN 'phenotypes' ELSE why END AS reason, n AS n_evidence FROM gk)
"""
_LEDGER = """WITH RECURSIVE ev AS (SELECT user_id, {} AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
lc AS (SELECT user_id, seq, payload, repeat('0', 64) AS prev_hash, sha256('0|' || payload || '|' || repeat('0', 64)) AS entry_hash FROM ev WHERE seq = 0
  UNION ALL SELECT ev.user_id, ev.seq, ev.payload, lc.entry_hash, sha256(CAST(ev.seq AS VARCHAR) || '|' || ev.payload || '|' || lc.entry_hash) FROM lc JOIN ev ON ev.user_id = lc.user_id AND ev.seq = lc.seq + 1)
"""
_FITS = """coalesce(e.value > 5, false) AND CASE {0} WHEN 'start' THEN e.event_type IN ('signup', 'view') WHEN 'signup' THEN e.event_type IN ('view', 'click') WHEN 'view' THEN e.event_type IN ('click', 'purchase', 'view')
  WHEN 'click' THEN e.event_type IN ('purchase', 'view') WHEN 'purchase' THEN e.event_type = 'view' WHEN 'error' THEN e.event_type = 'view' ELSE false END"""
_REPLAY = f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
rp AS (SELECT user_id, event_id, event_type AS action, 'start' AS previous, {_FITS.format("'start'")} AS allowed, k FROM ev AS e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.event_type, CASE WHEN rp.allowed THEN rp.action ELSE rp.previous END, {_FITS.format("CASE WHEN rp.allowed THEN rp.action ELSE rp.previous END")}, e.k FROM rp JOIN ev AS e ON e.user_id = rp.user_id AND e.k = rp.k + 1)
"""

SQL = {
    "accuracy_by_lineage": with_bindings("calls", _EVALUABLE + f""", k AS (SELECT drug, CASE WHEN GROUPING(l) = 1 THEN 'all' ELSE l END AS lineage, {_COUNTS} FROM e GROUP BY GROUPING SETS ((drug), (drug, l)))
SELECT k.*, {', '.join(f'round({_rate(n)}, 6) + 0.0 AS {n}' for n in _RATES)}, {', '.join(_wilson(n) for n in ('sensitivity', 'specificity', 'vme_rate', 'me_rate', 'call_rate'))} FROM k"""),
    "accuracy_verdicts": with_bindings("calls", _VERDICTS + "SELECT drug, n_evaluable, verdict, CASE WHEN verdict IN ('pass', 'fail') THEN r ELSE '' END AS reasons FROM w"),
    "verdict_counts": with_bindings("calls", _VERDICTS + "SELECT verdict, COUNT(*) AS n FROM w GROUP BY verdict"),
    "engine_concordance": with_bindings("calls", _CONCORDANCE.format("calls")),
    "aligned_concordance": with_bindings("calls", """, al AS (SELECT coalesce(a.drug, b.drug) AS drug, a.call_a AS call_a, b.call_b AS call_b FROM (SELECT * FROM calls WHERE call_a <> 'not_assessed') AS a
  FULL JOIN (SELECT * FROM calls WHERE call_b IS NOT NULL) AS b ON a.sample_id = b.sample_id AND a.drug = b.drug) """ + _CONCORDANCE.format("al")),
    "engine_agreement": with_bindings("calls", """ SELECT drug, state, COUNT(*) AS n FROM (SELECT sample_id, drug, CASE COUNT(c) WHEN 0 THEN 'unassessed' WHEN 1 THEN 'single_source' ELSE CASE WHEN MIN(c) = MAX(c) THEN 'agreed' ELSE 'disagreed' END END AS state
  FROM (SELECT sample_id, drug, CASE WHEN call_a <> 'not_assessed' THEN call_a END AS c FROM calls UNION ALL SELECT sample_id, drug, call_b FROM calls) GROUP BY sample_id, drug) GROUP BY drug, state"""),
    "species_control": with_bindings("calls", """ SELECT sample_id, COUNT(b) AS n_offending, coalesce(string_agg(DISTINCT b, ', ' ORDER BY b), '') AS offending, COUNT(b) = 0 AS passed
FROM (SELECT sample_id, CASE WHEN call_a <> 'not_assessed' THEN drug || '=' || call_a END AS b FROM calls) GROUP BY sample_id"""),
    "call_distribution": with_bindings("calls", " SELECT drug, call_a AS call, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY drug), 6) + 0.0 AS share FROM calls GROUP BY drug, call_a"),
    "call_matrix": with_bindings("calls", " SELECT sample_id, " + ", ".join(f"MAX(CASE WHEN substr(drug, 1, 1) = '{k}' THEN call_a END) AS drug_{k}" for k in range(1, 6)) + " FROM calls GROUP BY sample_id"),
    "risk_coverage_curve": with_bindings("calls", _CURVE + "SELECT drug, round(threshold, 6) + 0.0 AS threshold, n_total, n_covered, n_errors, round(coverage, 6) + 0.0 AS coverage, round(risk, 6) + 0.0 AS risk FROM cv"),
    "risk_coverage_area": with_bindings("calls", _CURVE + """, st AS (SELECT drug, coverage, risk, lead(coverage) OVER (PARTITION BY drug ORDER BY coverage) - coverage AS w, lead(risk) OVER (PARTITION BY drug ORDER BY coverage) AS nx FROM cv WHERE risk IS NOT NULL)
SELECT drug, round(SUM(CASE WHEN w > 0 THEN w * (risk + nx) / 2 END) / SUM(CASE WHEN w > 0 THEN w END), 6) + 0.0 AS area FROM st GROUP BY drug"""),
    "matched_coverage": with_bindings("calls", _CURVE + """, bs(drug, base_coverage, base_risk) AS (VALUES ('1-URGENT', 0.1, 0.5), ('2-HIGH', 0.3, 0.5), ('3-MEDIUM', 0.5, 0.5), ('4-NOT SPECIFIED', 0.7, 0.5), ('5-LOW', 0.9, 0.5)),
mt AS (SELECT bs.drug AS drug, base_coverage, base_risk, cv.coverage AS coverage, risk, row_number() OVER (PARTITION BY bs.drug ORDER BY cv.coverage) AS k FROM bs LEFT JOIN cv ON bs.drug = cv.drug AND cv.coverage >= base_coverage)
SELECT drug, round(CAST(base_coverage AS DOUBLE), 6) + 0.0 AS base_coverage, round(CAST(base_risk AS DOUBLE), 6) + 0.0 AS base_risk, round(risk, 6) + 0.0 AS risk, round(coverage, 6) + 0.0 AS coverage,
  CASE WHEN coverage IS NULL THEN 'cannot-match-coverage' WHEN risk IS NULL THEN 'underpowered' WHEN risk < base_risk THEN 'beats-baseline' ELSE 'no-better-than-baseline' END AS verdict FROM mt WHERE k = 1"""),
    "mic_parsed": with_bindings("raw_mic", _MIC + "SELECT isolate_id, drug, mic, censoring, round(mic_value, 6) + 0.0 AS mic_value FROM pd"),
    "censoring_profile": with_bindings("raw_mic", _MIC + """SELECT drug, COUNT(*) AS n, COUNT(CASE WHEN censoring = 'none' THEN 1 END) AS n_exact, COUNT(CASE WHEN censoring = 'left' THEN 1 END) AS n_left, COUNT(CASE WHEN censoring = 'right' THEN 1 END) AS n_right,
  round(COUNT(CASE WHEN censoring = 'left' THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) + 0.0 AS left_fraction, round(COUNT(CASE WHEN censoring = 'right' THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) + 0.0 AS right_fraction,
  COUNT(CASE WHEN censoring = 'left' THEN 1 END) * 2 < COUNT(*) AND COUNT(CASE WHEN censoring = 'right' THEN 1 END) * 2 < COUNT(*) AS identifiable FROM lg GROUP BY drug"""),
    "censored_median": with_bindings("raw_mic", _MIC + """, md AS (SELECT drug, COUNT(*) AS n, COUNT(CASE WHEN censoring = 'left' THEN 1 END) * 2 >= COUNT(*) AS lo, COUNT(CASE WHEN censoring = 'right' THEN 1 END) * 2 >= COUNT(*) AS hi,
  quantile_cont(CASE WHEN censoring = 'left' THEN -1e300 ELSE b END, 0.5) AS q1, quantile_cont(CASE WHEN censoring = 'right' THEN 1e300 ELSE b END, 0.5) AS q2 FROM lg GROUP BY drug)
SELECT drug, n, CASE WHEN NOT lo AND NOT hi AND q1 = q2 AND abs(q1) < 1e200 THEN round(q1, 6) + 0.0 END AS median_log2, CASE WHEN lo THEN 'below range' WHEN hi THEN 'above range' WHEN q1 = q2 AND abs(q1) < 1e200 THEN NULL ELSE 'no unique median' END AS reason FROM md"""),
    "censored_shift": with_bindings("raw_mic isolates carriage", _SHIFT + "SELECT * FROM sf"),
    "pooled_shift": with_bindings("raw_mic isolates carriage", _SHIFT + "SELECT label, drug, round(CAST(SUM(net) AS DOUBLE) / SUM(n_decisive), 6) + 0.0 AS delta, CAST(SUM(n_decisive) AS BIGINT) AS n_decisive FROM sh WHERE refused IS NULL GROUP BY label, drug"),
    "holm_adjusted": with_bindings("pvalues", """, rh AS (SELECT pair_id, CAST(p AS DOUBLE) AS p, rank() OVER (ORDER BY p) - 1 AS less, count(*) OVER () AS m FROM pvalues WHERE p IS NOT NULL),
hh AS (SELECT pair_id, p, max(least(1.0, p * (m - less))) OVER (ORDER BY p) AS holm FROM rh)
SELECT v.pair_id AS pair_id, round(CAST(v.p AS DOUBLE), 6) + 0.0 AS p, round(holm, 6) + 0.0 AS holm FROM pvalues AS v LEFT JOIN hh ON v.pair_id = hh.pair_id"""),
    "discoveries": with_bindings("pvalues", """, rb AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM (SELECT CAST(p AS DOUBLE) AS p FROM pvalues WHERE p IS NOT NULL)),
tb AS (SELECT max(p) AS t FROM rb WHERE p <= CAST(0.9 AS DOUBLE) * k / m) SELECT pair_id, coalesce(CAST(p AS DOUBLE) <= (SELECT t FROM tb), false) AS survives FROM pvalues"""),
    "federated_associations": with_bindings("observations", """, kn AS (SELECT arrival, isolate_id, site_id, drug, phenotype, variant, coalesce(lineage, 'unknown') AS lineage FROM observations WHERE phenotype IN ('R', 'S')),
o1 AS (SELECT *, row_number() OVER (PARTITION BY variant, drug, isolate_id ORDER BY arrival) AS k FROM kn),
a1 AS (SELECT variant, drug, COUNT(*) AS n, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS n_r, COUNT(CASE WHEN phenotype = 'S' THEN 1 END) AS n_s, COUNT(DISTINCT site_id) AS n_sites, COUNT(DISTINCT lineage) AS n_lineages FROM o1 WHERE k = 1 AND variant IS NOT NULL GROUP BY variant, drug),
o2 AS (SELECT drug, phenotype, row_number() OVER (PARTITION BY drug, isolate_id ORDER BY arrival) AS k FROM kn),
c1 AS (SELECT drug, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS cohort_r, COUNT(CASE WHEN phenotype = 'S' THEN 1 END) AS cohort_s FROM o2 WHERE k = 1 GROUP BY drug),
g1 AS (SELECT a1.*, cohort_r, cohort_s, CAST(n_r AS DOUBLE) / n AS f FROM a1 JOIN c1 ON a1.drug = c1.drug),
g2 AS (SELECT *, concat_ws(',', CASE WHEN n < 5 THEN 'isolates' END, CASE WHEN f < 0.4 THEN 'fraction' END, CASE WHEN n_sites < 3 THEN 'sites' END, CASE WHEN cohort_s < 10 THEN 'susceptible cohort' END, CASE WHEN cohort_s - n_s <= 0 THEN 'controls' END, CASE WHEN n_lineages < 3 THEN 'lineages' END) AS failed FROM g1)
SELECT variant, drug, n, n_r, n_s, n_sites, n_lineages, cohort_r, cohort_s, round(f, 6) + 0.0 AS r_fraction, failed = '' AS eligible, failed FROM g2"""),
    "disclosure_check": with_bindings("observations", " SELECT variant, drug, COUNT(DISTINCT isolate_id) AS n_isolates, COUNT(DISTINCT site_id) AS n_sites FROM observations WHERE variant IS NOT NULL GROUP BY variant, drug HAVING COUNT(DISTINCT isolate_id) < 5 OR COUNT(DISTINCT site_id) < 2"),
    "small_cell_suppression": with_bindings("observations", """, ce AS (SELECT variant, drug FROM observations WHERE variant IS NOT NULL GROUP BY variant, drug HAVING COUNT(DISTINCT isolate_id) >= 7)
SELECT arrival, o.drug AS drug, COUNT(DISTINCT o.variant) AS n_kept, MIN(o.variant) AS first_variant, MAX(o.variant) AS last_variant FROM observations AS o JOIN ce ON o.variant = ce.variant AND o.drug = ce.drug GROUP BY arrival, o.drug"""),
    "study_dependence": with_bindings("cohort", """, pc AS (SELECT tier, project, COUNT(*) AS c FROM cohort GROUP BY tier, project)
SELECT tier, COUNT(*) AS n_groups, CAST(SUM(c) AS BIGINT) AS n, round(MAX(c) / CAST(SUM(c) AS DOUBLE), 6) + 0.0 AS largest_share, round(CAST(SUM(c) AS DOUBLE) * SUM(c) / SUM(c * c), 6) + 0.0 AS effective_n FROM pc GROUP BY tier"""),
    "cohort_summary": with_bindings("cohort", """ SELECT 'all' AS dimension, NULL AS item, COUNT(*) AS n, CAST(SUM(bases) AS BIGINT) AS total FROM cohort UNION ALL SELECT 'project', project, COUNT(*), CAST(SUM(bases) AS BIGINT) FROM cohort GROUP BY project
UNION ALL SELECT 'organism', organism, COUNT(*), CAST(SUM(bases) AS BIGINT) FROM cohort GROUP BY organism UNION ALL SELECT 'tier', tier, COUNT(*), CAST(SUM(bases) AS BIGINT) FROM cohort GROUP BY tier"""),
    "site_discordance": with_bindings("site_calls", """, cv AS (SELECT DISTINCT variant, drug, call, version FROM site_calls),
dc AS (SELECT variant, drug, COUNT(DISTINCT call) AS n_calls, MAX(CASE WHEN version IS NULL THEN 1 ELSE 0 END) AS unknown FROM cv GROUP BY variant, drug HAVING COUNT(DISTINCT call) > 1),
cs AS (SELECT variant, drug, call, list(version) AS vs FROM cv WHERE version IS NOT NULL GROUP BY variant, drug, call),
pj AS (SELECT a.variant AS variant, a.drug AS drug, MAX(CASE WHEN list_has_any(a.vs, b.vs) THEN 0 ELSE 1 END) AS apart FROM cs AS a JOIN cs AS b ON a.variant = b.variant AND a.drug = b.drug AND a.call < b.call GROUP BY a.variant, a.drug)
SELECT dc.variant AS variant, dc.drug AS drug, n_calls, CASE WHEN unknown = 1 THEN 'unknown' WHEN apart = 1 THEN 'version-explained' ELSE 'rule-explained' END AS kind FROM dc LEFT JOIN pj ON dc.variant = pj.variant AND dc.drug = pj.drug"""),
    "latest_call": with_bindings("observations", """ SELECT isolate_id, drug, arrival, phenotype FROM (SELECT isolate_id, drug, arrival, phenotype, row_number() OVER (PARTITION BY isolate_id, drug ORDER BY arrival DESC) AS k
  FROM (SELECT DISTINCT isolate_id, drug, arrival, phenotype FROM observations)) WHERE k = 1"""),
    "drift_state": """WITH dd AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(value) AS n, AVG(value) AS m FROM events GROUP BY event_type, CAST(ts AS DATE))
SELECT event_type, day, n, round(m, 6) + 0.0 AS mean, CASE WHEN n < 60 THEN 'not_assessed' WHEN 50.0 - m >= 1.0 THEN 'alarm' ELSE 'stable' END AS state FROM dd""",
    "calibration_error": with_bindings("calls", _PREDICTIONS + """, bn AS (SELECT drug, least(4, floor(confidence * 5)) AS b, COUNT(*) AS n, SUM(confidence) AS p, COUNT(CASE WHEN truth = 'resistant' THEN 1 END) AS r FROM pr GROUP BY drug, least(4, floor(confidence * 5))),
ec AS (SELECT drug, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(r) AS BIGINT) AS n_r, SUM(abs(p - r)) AS gap FROM bn GROUP BY drug),
rf AS (SELECT *, CASE WHEN n < 30 THEN 'too few rows' WHEN n_r < 10 THEN 'too few resistant' WHEN n - n_r < 10 THEN 'too few susceptible' END AS refused FROM ec)
SELECT drug, n, n_r, refused, CASE WHEN refused IS NULL THEN round(gap / n, 6) + 0.0 END AS ece FROM rf"""),
    "ledger_entries": _LEDGER.format("event_type") + "SELECT user_id, seq, payload, prev_hash, entry_hash FROM lc",
    "ledger_links": _LEDGER.format("event_type || ':' || props") + """, sp AS (SELECT user_id, seq, payload, CASE WHEN (user_id * 31 + seq) % 23 = 7 THEN 'x' ELSE prev_hash END AS prev_hash, CASE WHEN (user_id * 31 + seq) % 17 = 3 THEN sha256(payload) ELSE entry_hash END AS entry_hash FROM lc WHERE (user_id * 31 + seq) % 29 <> 11),
dp AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE (user_id * 31 + seq) % 37 = 5),
pt AS (SELECT user_id, seq, COUNT(*) AS times, MAX(entry_hash) AS h FROM dp GROUP BY user_id, seq),
jn AS (SELECT d.*, p.times AS times, b.h AS before FROM dp AS d JOIN pt AS p ON p.user_id = d.user_id AND p.seq = d.seq LEFT JOIN pt AS b ON b.user_id = d.user_id AND b.seq + 1 = d.seq)
SELECT user_id, seq, reason FROM (SELECT user_id, seq, CASE WHEN times > 1 THEN 'repeated' WHEN seq > 0 AND before IS NULL THEN 'gap' WHEN prev_hash <> coalesce(before, repeat('0', 64)) THEN 'broken link'
  WHEN entry_hash <> sha256(CAST(seq AS VARCHAR) || '|' || payload || '|' || prev_hash) THEN 'altered entry' END AS reason FROM jn) WHERE reason IS NOT NULL""",
    "ticket_replay": _REPLAY + "SELECT user_id, event_id, action, previous, allowed FROM rp",
    "ticket_states": _REPLAY + "SELECT user_id, arg_max(action, event_id) FILTER (WHERE allowed) AS state, COUNT(CASE WHEN NOT allowed THEN 1 END) AS n_refused FROM rp GROUP BY user_id",
    "scope_permits": with_bindings("scopes contexts qc", _PERMITS + "SELECT * FROM pm"),
    "genotype_match": with_bindings("vcf coordinates", _ALLELES + "SELECT * FROM gm"),
    "carriers_per_variant": with_bindings("vcf coordinates", _ALLELES + "SELECT label, COUNT(DISTINCT file) AS n_carriers FROM gm WHERE carried GROUP BY label"),
    "scan_status": with_bindings("vcf coordinates", _ALLELES + "SELECT status, COUNT(*) AS n_alleles, COUNT(CASE WHEN carried THEN 1 END) AS n_carried FROM ac GROUP BY status"),
    "load_summary": with_bindings("vcf coordinates", _ALLELES + """, cs AS (SELECT file, COUNT(*) AS n_alleles, COUNT(CASE WHEN status = 'ok' THEN 1 END) AS n_ok, COUNT(CASE WHEN status = 'filtered' THEN 1 END) AS n_filtered, COUNT(CASE WHEN status = 'error' THEN 1 END) AS n_error FROM ac GROUP BY file),
lb AS (SELECT file, COUNT(*) AS n, COUNT(CASE WHEN carried THEN 1 END) AS c FROM gm GROUP BY file)
SELECT cs.*, 'chr' AS contigs, coalesce(n, 0) AS n_assessed, coalesce(c, 0) AS n_carried, round(1 - n_ok / CAST(n_alleles AS DOUBLE), 6) + 0.0 AS lost_fraction FROM cs LEFT JOIN lb ON lb.file = cs.file WHERE CAST(cs.file AS BIGINT) % 7 <> 3"""),
    "trimmed_alleles": with_bindings("vcf", """ SELECT DISTINCT pos, ref, 'CAT' AS alt, pos + 2 AS new_pos, 'G' AS new_ref, 'T' AS new_alt FROM vcf WHERE kind = 1
UNION ALL SELECT DISTINCT pos, ref, 'CTG', pos + 1, 'A', 'T' FROM vcf WHERE kind = 1"""),
    "gvcf_coverage": with_bindings("blocks spans", """, ov AS (SELECT s.chrom AS chrom, s.locus AS locus, least(b.stop, s.stop) - greatest(b.start, s.start) AS o, depth FROM blocks AS b JOIN spans AS s ON b.chrom = s.chrom AND b.start < s.stop AND s.start < b.stop),
os AS (SELECT chrom, locus, SUM(CASE WHEN depth >= 10 THEN o END) AS ok, SUM(depth * o) AS d, SUM(o) AS c FROM ov GROUP BY chrom, locus)
SELECT s.chrom AS chrom, s.locus AS locus, round(least(1.0, coalesce(ok, 0) / CAST(s.stop - s.start AS DOUBLE)), 6) + 0.0 AS callable_fraction, round(d / CAST(c AS DOUBLE), 6) + 0.0 AS mean_depth
FROM spans AS s LEFT JOIN os ON os.chrom = s.chrom AND os.locus = s.locus"""),
    "coverage_merge": with_bindings("coverage", """, tw AS (SELECT isolate_id, locus, CASE WHEN mean_depth % 3 > 0 THEN CAST(callable_fraction AS DOUBLE) END AS f FROM coverage)
SELECT isolate_id, locus, round(greatest(coalesce(f, 0.0), 0.9), 6) + 0.0 AS callable_fraction, CASE WHEN f >= CAST(0.9 AS DOUBLE) THEN 'a' ELSE 'b' END AS source FROM tw"""),
    "required_loci_gate": with_bindings("isolates profile coverage", _GATE + "SELECT * FROM gate"),
    "locus_callability": with_bindings("coverage", " SELECT locus, COUNT(callable_fraction) AS n_known, COUNT(CASE WHEN callable_fraction >= 0.8 THEN 1 END) AS n_callable, round(COUNT(CASE WHEN callable_fraction >= 0.8 THEN 1 END) / CAST(COUNT(callable_fraction) AS DOUBLE), 6) + 0.0 AS share FROM coverage GROUP BY locus"),
    "reconciled_calls": with_bindings("isolates profile coverage evidence scopes contexts qc", _RECONCILED + "SELECT * FROM rc"),
    "regimen_eligibility": with_bindings("isolates profile coverage evidence scopes contexts qc", _RECONCILED + """, mb AS (SELECT DISTINCT drug, 'all' AS regimen, 2 AS min_required FROM profile UNION ALL SELECT DISTINCT drug, 'first', 1 FROM profile WHERE drug < 'M')
SELECT isolate_id, regimen, min_required, COUNT(CASE WHEN call = 'susceptible' THEN 1 END) AS n_usable, coalesce(string_agg(CASE WHEN call = 'resistant' THEN rc.drug END, ',' ORDER BY rc.drug), '') AS resistant,
  coalesce(string_agg(CASE WHEN call NOT IN ('susceptible', 'resistant') THEN rc.drug END, ',' ORDER BY rc.drug), '') AS unestablished, greatest(0, min_required - COUNT(CASE WHEN call = 'susceptible' THEN 1 END)) AS shortfall,
  COUNT(CASE WHEN call = 'susceptible' THEN 1 END) >= min_required AS eligible FROM rc JOIN mb ON rc.drug = mb.drug GROUP BY isolate_id, regimen, min_required"""),
    "strata_carriers": with_bindings("isolates carriage determinants", """, bg AS (SELECT c.isolate_id AS isolate_id, d.drug AS drug, string_agg(DISTINCT c.label, '+' ORDER BY c.label) AS b FROM carriage AS c JOIN determinants AS d ON c.label = d.label GROUP BY c.isolate_id, d.drug),
pl AS (SELECT i.*, d.drug AS drug, coalesce(b, '') AS background FROM isolates AS i CROSS JOIN (SELECT DISTINCT drug FROM determinants) AS d LEFT JOIN bg ON bg.isolate_id = i.isolate_id AND bg.drug = d.drug),
sz AS (SELECT drug, background, lineage, site_id, COUNT(*) AS n FROM pl GROUP BY drug, background, lineage, site_id),
hd AS (SELECT label, drug, background, lineage, site_id, COUNT(*) AS k FROM pl JOIN carriage AS c ON c.isolate_id = pl.isolate_id WHERE label NOT IN (SELECT label FROM determinants) GROUP BY label, drug, background, lineage, site_id)
SELECT label, hd.drug AS drug, hd.background AS background, hd.lineage AS lineage, hd.site_id AS site_id, k AS n_carriers, n - k AS n_others FROM hd JOIN sz ON hd.drug = sz.drug AND hd.background = sz.background AND hd.lineage IS NOT DISTINCT FROM sz.lineage AND hd.site_id = sz.site_id"""),
    "determinant_cooccurrence": with_bindings("carriage determinants", """, mi AS (SELECT isolate_id, label FROM carriage WHERE label NOT IN (SELECT label FROM determinants)), tt AS (SELECT label, COUNT(*) AS n FROM mi GROUP BY label)
SELECT mi.label AS candidate, c.label AS label, COUNT(*) AS n_both, round(COUNT(*) / CAST(max(n) AS DOUBLE), 6) + 0.0 AS fraction FROM mi JOIN carriage AS c ON c.isolate_id = mi.isolate_id JOIN tt ON tt.label = mi.label
WHERE c.label IN (SELECT label FROM determinants) AND c.label <> mi.label GROUP BY mi.label, c.label"""),
    "phenotypes_long": with_bindings("wide isolates", """, ln AS (SELECT sample_id, run, 'rifampicin' AS drug, nullif(trim(rif_phenotype), '') AS phenotype, nullif(trim(rif_quality), '') AS quality, nullif(trim(rif_mic), '') AS mic FROM wide
UNION ALL SELECT sample_id, run, 'isoniazid', nullif(trim(inh_phenotype), ''), nullif(trim(inh_quality), ''), nullif(trim(inh_mic), '') FROM wide),
rs AS (SELECT *, CASE WHEN phenotype IS NULL THEN 'no phenotype' WHEN upper(phenotype) NOT IN ('R', 'S') THEN 'not R or S' WHEN coalesce(upper(quality), '') <> 'HIGH' THEN 'quality' END AS reason
  FROM ln WHERE run <> 'NONE' AND sample_id NOT IN (SELECT isolate_id FROM isolates WHERE lineage IS NULL) AND (phenotype IS NOT NULL OR mic IS NOT NULL))
SELECT *, reason IS NULL AS evaluable FROM rs"""),
    "monitoring_totals": with_bindings("stream_rows", """, ev AS (SELECT drug, coalesce(nullif(trim(lineage), ''), 'unknown') AS lineage, lower(predicted) AS c, upper(phenotype) AS p FROM stream_rows WHERE phenotype IS NOT NULL)
SELECT drug, lineage, COUNT(CASE WHEN c = 'resistant' AND p = 'R' THEN 1 END) AS tp, COUNT(CASE WHEN c = 'resistant' AND p = 'S' THEN 1 END) AS fp, COUNT(CASE WHEN c = 'susceptible' AND p = 'S' THEN 1 END) AS tn,
  COUNT(CASE WHEN c = 'susceptible' AND p = 'R' THEN 1 END) AS fn, COUNT(CASE WHEN c = 'not_assessed' THEN 1 END) AS abstained FROM ev GROUP BY drug, lineage"""),
    "event_trend": """SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS start, COUNT(value) AS n, round(AVG(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2""",
    "catalogue_entries": with_bindings("master", """, gr AS (SELECT gene, change, drug, CASE lower(trim(grade)) WHEN '1) assoc w r' THEN 3 WHEN '2) assoc w r - interim' THEN 3 WHEN '3) uncertain significance' THEN 2 WHEN '4) not assoc w r - interim' THEN 1 WHEN '5) not assoc w r' THEN 1 END AS g FROM master WHERE trim(change) <> '')
SELECT gene, change, string_agg(DISTINCT drug, ',' ORDER BY drug) AS drugs, CASE max(g) WHEN 3 THEN 'resistant' WHEN 2 THEN 'indeterminate' ELSE 'not_associated' END AS call, gene || '_' || change AS label FROM gr WHERE g IS NOT NULL GROUP BY gene, change"""),
    "catalogue_skipped": with_bindings("master", " SELECT CASE WHEN trim(change) = '' THEN 'incomplete' ELSE 'unknown grade' END AS skip_reason, COUNT(*) AS n FROM master WHERE trim(change) = '' OR grade = 'other' GROUP BY 1"),
    "generalizability": with_bindings("calls", " SELECT drug, COUNT(DISTINCT lineage) AS n_lineages, string_agg(DISTINCT lineage, ',' ORDER BY lineage) AS lineages, COUNT(DISTINCT lineage) >= 2 AS generalizable FROM calls GROUP BY drug"),
    "population_prevalence": with_bindings("calls", """ SELECT drug, lineage, site, COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) AS n_tested, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS n_resistant, CAST(GROUPING(drug, lineage, site) AS INTEGER) AS level,
  CASE WHEN COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) > 0 THEN round(COUNT(CASE WHEN phenotype = 'R' THEN 1 END) / CAST(COUNT(CASE WHEN phenotype IN ('R', 'S') THEN 1 END) AS DOUBLE), 6) + 0.0 END AS rate FROM (SELECT *, CAST(site_id AS VARCHAR) AS site FROM calls) GROUP BY ROLLUP (drug, lineage, site)"""),
    "tier_composition": with_bindings("evidence", " SELECT drug, tier, COUNT(*) AS n, round(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY drug) AS DOUBLE), 6) + 0.0 AS share FROM evidence GROUP BY drug, tier"),
    "isolate_sample": with_bindings("isolates", " SELECT isolate_id, site_id, lineage FROM isolates ORDER BY md5('7:' || CAST(isolate_id AS VARCHAR)), isolate_id LIMIT 40"),
    "validation_queue": with_bindings("pvalues", """, rb AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM (SELECT CAST(p AS DOUBLE) AS p FROM pvalues WHERE p IS NOT NULL)),
tb AS (SELECT max(p) AS t FROM rb WHERE p <= CAST(0.9 AS DOUBLE) * k / m),
sc AS (SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN 'evidence-of-effect' WHEN 1 THEN 'no-evidence' ELSE 'confounded' END AS verdict, coalesce(CAST(p AS DOUBLE) <= (SELECT t FROM tb), false) AS survives, round((pair_id * 13 % 200 - 100) / CAST(100 AS DOUBLE), 6) + 0.0 AS delta FROM pvalues)
SELECT * FROM sc WHERE verdict <> 'confounded' ORDER BY survives DESC, abs(delta) DESC, pair_id LIMIT 50"""),
    "predictions_with_truth": with_bindings("calls", """ SELECT p.sample_id AS sample_id, p.drug AS drug, p.call_a AS call_a, t.phenotype AS truth, CASE WHEN t.phenotype IS NULL THEN 'no truth' END AS dropped
FROM calls AS p LEFT JOIN (SELECT * FROM calls WHERE phenotype IS NOT NULL) AS t ON p.sample_id = t.sample_id AND p.drug = t.drug"""),
    "cohort_fingerprint": with_bindings("cohort", " SELECT COUNT(*) AS n, CAST(SUM(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_a, CAST(SUM(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_b FROM (SELECT sha256("
      + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("sample_id", "project", "tier", "organism", "bases")) + ") AS d FROM cohort)"),
    "concentration_calls": with_bindings("raw_mic", _MIC + """, cc AS (SELECT isolate_id, drug, mic, censoring, mic_value AS v, CASE WHEN drug < '3' THEN 1.0 ELSE 4.0 END AS c, isolate_id % 3 AS i FROM pd WHERE mic_value IS NOT NULL)
SELECT isolate_id, drug, mic, CASE WHEN censoring = 'left' THEN CASE WHEN v < c OR v = c AND i = 0 THEN 'susceptible' END WHEN censoring = 'right' THEN CASE WHEN v >= c THEN 'resistant' END
  WHEN v > c OR v = c AND i = 1 THEN 'resistant' WHEN v < c OR v = c AND i = 0 THEN 'susceptible' END AS call FROM cc"""),
    "minority_posteriors": """WITH pi AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-60.0 * (l_discount - 0.05))) AS s, l_tax AS f, CASE WHEN l_linenumber < 7 THEN l_linenumber * 3 END AS n, CASE WHEN l_orderkey % 11 > 0 THEN (l_orderkey % 11 - 1) / CAST(8 AS DOUBLE) END AS q FROM lineitem),
po AS (SELECT *, CASE WHEN n IS NOT NULL AND q BETWEEN 0 AND 1 AND s * q + f * (1 - q) > 0 THEN least(1.0, greatest(0.0, s * q / (s * q + f * (1 - q)))) END AS p, CASE WHEN n < 5 THEN 0.5 ELSE greatest(0.03, 1 / sqrt(n)) END AS w FROM pi)
SELECT l_orderkey, l_linenumber, round(p, 4) + 0.0 AS probability, CASE WHEN p IS NOT NULL THEN round(greatest(0.0, p - w), 4) + 0.0 END AS low, CASE WHEN p IS NOT NULL THEN round(least(1.0, p + w), 4) + 0.0 END AS high FROM po""",
    "paired_change": with_bindings("paired", """, ch AS (SELECT 'minutes' AS measure, 'native_unit' AS unit, CAST(intervention_minutes - baseline_minutes AS DOUBLE) AS c FROM paired
UNION ALL SELECT 'cost', coalesce(currency, ''), CAST(intervention_cost - baseline_cost AS DOUBLE) FROM paired)
SELECT measure, unit, COUNT(*) AS n_pairs, round(AVG(c), 4) + 0.0 AS mean_change, round(quantile_cont(c, 0.5), 4) + 0.0 AS median_change FROM ch WHERE c IS NOT NULL GROUP BY measure, unit"""),
    "submission_checks": """WITH su AS (SELECT event_id AS submission_id, event_id * 7 % 1500 AS nonce, ts, CASE WHEN event_id % 40 - 3 > 24 THEN 'stale' WHEN event_id % 40 - 3 < -1 THEN 'future' END AS late FROM events),
pr AS (SELECT *, coalesce(sum(CASE WHEN late IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY nonce ORDER BY ts, submission_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM su)
SELECT submission_id, nonce, CASE WHEN e > 0 THEN 'replayed' ELSE late END AS reject_reason FROM pr""",
    "scan_finalised": with_bindings("pvalues", """, rp AS (SELECT pair_id, CAST(p AS DOUBLE) / 100 AS p, CASE WHEN pair_id % 3 = 0 THEN 'evidence-of-effect' ELSE 'no-evidence' END AS v FROM pvalues),
rh AS (SELECT pair_id, p, rank() OVER (ORDER BY p) - 1 AS less, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM rp WHERE p IS NOT NULL),
hh AS (SELECT pair_id, max(least(1.0, p * (m - less))) OVER (ORDER BY p) AS holm, (SELECT max(p) FROM rh AS z WHERE z.p <= CAST(0.1 AS DOUBLE) * z.k / z.m) AS t FROM rh)
SELECT verdict, survives, COUNT(*) AS n FROM (SELECT CASE WHEN v = 'evidence-of-effect' AND holm > CAST(0.1 AS DOUBLE) THEN 'no-evidence' ELSE v END AS verdict, coalesce(p <= t, false) AS survives FROM rp LEFT JOIN hh ON rp.pair_id = hh.pair_id) GROUP BY verdict, survives"""),
} | effect_scan.SQL | tool_outputs.SQL | variant_lanes.SQL | report_views.SQL | streams.SQL | follow_ups.SQL | loads.sql(_ALLELES, report_views.SQL["external_benchmark"])
SQL |= shown_views.sql(_RECONCILED, SQL["concentration_calls"])
