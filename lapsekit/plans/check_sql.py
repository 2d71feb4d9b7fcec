"""Plain SQL with the same results as the registered queries, to check them.

Written from the definitions and without use of the operators: windows in place
of set aggregation, ``row_number`` in place of digest cutoffs, ranks in place
of counted ranges.
"""

from __future__ import annotations

from lapsekit.plans.queries import DIGITS, MODEL_LABEL, PLANTED, SAMPLE_ROWS, SCORE_KEYS, SKETCHED_FROM, SKETCHED_TO
from lapsekit.settings import BINARY_FEATURES, FEATURES, LUMP_LIMITS, RISK_DOMAINS

_DOMAIN_COUNTS = ",\n".join(
    f"MAX(CASE WHEN value > 150 AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 = {i}"
    f" THEN 1 ELSE 0 END) AS {name}"
    for i, name in enumerate(RISK_DOMAINS)
)
_DOMAIN_FLAGS = ",\n".join(f"CAST(COALESCE({name}, 0) AS INTEGER) AS {name}" for name in RISK_DOMAINS)
_DOMAIN_SUM = " + ".join(f"COALESCE({name}, 0)" for name in RISK_DOMAINS)

_PLANTED = " AND ".join(f"{name} {'=' if has else '<>'} '{level}'" for name, (level, has) in PLANTED.items())

JOURNEYS = f"""
WITH encounter AS (
  SELECT o_custkey AS patient, l_linestatus AS part, CAST(l_shipdate AS DATE) AS day,
         l_orderkey, l_linenumber, l_partkey, l_returnflag, o_orderpriority, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate IS NOT NULL
),
visit_day AS (
  SELECT patient, part, day, day - LAG(day) OVER (PARTITION BY patient, part ORDER BY day) AS gap
  FROM (SELECT DISTINCT patient, part, day FROM encounter)
),
gaps AS (
  SELECT patient, part, CAST(MAX(gap) AS INTEGER) AS max_gap, COUNT(*) AS visit_days
  FROM visit_day GROUP BY patient, part
),
sizes AS (SELECT patient, part, COUNT(*) AS encounters FROM encounter GROUP BY patient, part),
first_encounter AS (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (
      PARTITION BY patient, part ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_returnflag) AS place
    FROM encounter)
  WHERE place = 1
),
screening AS (
  SELECT user_id, COUNT(DISTINCT event_type) AS domains,
  {_DOMAIN_COUNTS}
  FROM events GROUP BY user_id
),
journeys AS (
  SELECT CAST(f.patient AS VARCHAR) || '-' || f.part AS JourneyKey,
    f.patient AS PatientDurableKey,
    f.day AS FirstDate,
    max_gap AS MaxGapDays,
    CAST(max_gap > 90 AS INTEGER) AS LongGap90,
    CAST(max_gap > 180 AS INTEGER) AS LongGap180,
    CAST(max_gap > 365 AS INTEGER) AS LongGap365,
    encounters AS NumEncounters,
    visit_days AS NumVisitDays,
    o_orderpriority AS FirstEncounterType,
    p_type || ' ' || CAST(p_size AS VARCHAR) AS FirstVisitTypeDescription,
    l_returnflag AS FirstDepartmentType,
    p_brand AS FirstDepartmentSpecialty,
    CAST(year(f.day) AS INTEGER) AS FirstEncounterYear,
    CAST(CAST(floor(c_acctbal / 500) AS BIGINT) AS VARCHAR) AS PatientBirthYearBin,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS SexAssignedAtBirth,
    r_name AS OmbRace,
    n_name AS OmbEthnicity,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Activated' WHEN 'BUILDING' THEN 'Pending Activation'
      WHEN 'HOUSEHOLD' THEN 'Inactivated' WHEN 'FURNITURE' THEN 'Patient Declined' END AS MyChartStatus,
    o_orderstatus AS SmokingStatus,
    CAST(user_id IS NOT NULL AS INTEGER) AS HasSdohScreening,
    CAST(COALESCE(domains, 0) AS INTEGER) AS SdohDomainsAnswered,
    CAST(({_DOMAIN_SUM}) > 0 AS INTEGER) AS AnySocialRisk,
    {_DOMAIN_FLAGS},
    CAST({_DOMAIN_SUM} AS INTEGER) AS SocialRiskCount
  FROM first_encounter f
  JOIN gaps g ON g.patient = f.patient AND g.part = f.part
  JOIN sizes s ON s.patient = f.patient AND s.part = f.part
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN customer ON c_custkey = f.patient
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN screening ON user_id = f.patient
)"""

OBSERVED = f"""{JOURNEYS},
observed AS (
  SELECT *, CAST(DATE_DIFF('day', FirstDate, DATE '1996-06-30') AS INTEGER) AS ObservationDays
  FROM journeys WHERE FirstDate IS NOT NULL
)"""

ELIGIBLE = f"""{OBSERVED},
eligible AS (SELECT * FROM observed WHERE ObservationDays >= 365),
charted AS (SELECT * FROM eligible WHERE MaxGapDays IS NOT NULL AND MaxGapDays BETWEEN 0 AND 1460)"""


def _percent(rate: str) -> str:
    """Rate as text, rounded half to even at one digit; adding zero makes -0 read 0."""
    number = f"CAST(round_even(({rate}) * 100, 1) + 0.0::DOUBLE AS VARCHAR)"
    return f"regexp_replace({number}, '[.]0$', '') || '%'"


def _spaced_at_capitals(text: str) -> str:
    return f"({text})[1] || regexp_replace(substring({text}, 2), '([A-Z])', ' \\1', 'g')"


def _titled(text: str) -> str:
    word = "upper(w[1]) || lower(w[2:])"
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: {word}), ' ')"


def _levels() -> str:
    """All levels of the lumped columns with count, rank and whether they stay."""
    counted = " UNION ALL ".join(
        f"SELECT '{name}' AS variable, {name} AS level, {n} AS keep_n, COUNT(*) AS journeys"
        f" FROM candidates WHERE {name} IS NOT NULL GROUP BY {name}"
        for name, n in LUMP_LIMITS.items()
    )
    return f"""{ELIGIBLE},
candidates AS (SELECT * FROM eligible WHERE {MODEL_LABEL} IS NOT NULL),
counted AS ({counted}),
ranked AS (
  SELECT *, RANK() OVER (PARTITION BY variable ORDER BY journeys DESC) AS level_rank FROM counted),
levels AS (
  SELECT *, level_rank <= keep_n
    OR SUM(CASE WHEN level_rank > keep_n THEN 1 ELSE 0 END) OVER (PARTITION BY variable) <= 1 AS kept
  FROM ranked)"""


def _model() -> str:
    lumped = ",\n".join(
        f"CASE WHEN {name} IS NULL THEN NULL"
        f" WHEN {name} IN (SELECT level FROM levels WHERE variable = '{name}' AND kept) THEN {name}"
        f" ELSE 'Other' END AS {name}"
        for name in LUMP_LIMITS
    )
    others = ", ".join([*BINARY_FEATURES, "SdohDomainsAnswered", "SocialRiskCount"])
    complete = " AND ".join(f"{name} IS NOT NULL" for name in (MODEL_LABEL, *FEATURES))
    return f"""{_levels()},
lumped AS (SELECT JourneyKey, PatientDurableKey, {MODEL_LABEL}, {lumped}, {others} FROM candidates),
model AS (SELECT * FROM lumped WHERE {complete})"""


def _split() -> str:
    return f"""{_model()},
rows_in_order AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY md5('123:' || JourneyKey), JourneyKey) AS place, COUNT(*) OVER () AS n
  FROM model),
split AS (
  SELECT *, CASE WHEN place <= floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM rows_in_order),
train AS (SELECT * FROM split WHERE split = 'train')"""


def _scored() -> str:
    tables, joins, rates = [], [], []
    for i, key in enumerate(SCORE_KEYS):
        tables.append(
            f"rate{i} AS (SELECT {key} AS level, (SUM({MODEL_LABEL}) + 20.0::DOUBLE * (SELECT rate FROM base))"
            f" / (COUNT(*) + 20.0::DOUBLE) AS rate FROM train GROUP BY {key})"
        )
        joins.append(f"LEFT JOIN rate{i} ON rate{i}.level = s.{key}")
        rates.append(f"COALESCE(rate{i}.rate, (SELECT rate FROM base))")
    return f"""{_split()},
base AS (SELECT CAST(SUM({MODEL_LABEL}) AS DOUBLE) / COUNT(*) AS rate FROM train),
{', '.join(tables)},
scored AS (
  SELECT s.JourneyKey, s.PatientDurableKey, s.{MODEL_LABEL} AS y,
    (0.0::DOUBLE + {' + '.join(rates)}) / {len(SCORE_KEYS)} AS p
  FROM split s {' '.join(joins)} WHERE split = 'test'),
auc AS (
  SELECT SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END * a.n * b.n)
    / (SUM(a.n * b.n)) AS auc
  FROM (SELECT p, COUNT(*)::DOUBLE AS n FROM scored WHERE y = 1 GROUP BY p) a,
       (SELECT p, COUNT(*)::DOUBLE AS n FROM scored WHERE y = 0 GROUP BY p) b)"""


def _tiered() -> str:
    return f"""{_scored()},
cuts AS (SELECT quantile_cont(p, 1.0/3) AS low, quantile_cont(p, 2.0/3) AS high FROM scored),
tiered AS (
  SELECT *, CASE WHEN p < low THEN 'Low' WHEN p < high THEN 'Medium' ELSE 'High' END AS risk_group
  FROM scored, cuts)"""


def _scored_all() -> str:
    """Every eligible journey by the rates and cuts of the split rows."""
    joins = " ".join(f"LEFT JOIN rate{i} ON rate{i}.level = e.{key}" for i, key in enumerate(SCORE_KEYS))
    rates = " + ".join(f"COALESCE(rate{i}.rate, (SELECT rate FROM base))" for i in range(len(SCORE_KEYS)))
    lumped = ", ".join(
        f"CASE WHEN {key} IS NULL OR {key} IN (SELECT level FROM levels WHERE variable = '{key}' AND kept) THEN {key} ELSE 'Other' END AS {key}"
        for key in SCORE_KEYS
    )
    return f"""{_tiered()},
every_lumped AS (SELECT JourneyKey, PatientDurableKey, {lumped} FROM eligible),
every_scored AS (
  SELECT JourneyKey, PatientDurableKey, (0.0::DOUBLE + {rates}) / {len(SCORE_KEYS)} AS p FROM every_lumped e {joins}),
everyone AS (
  SELECT *, CASE WHEN p < low THEN 'Low' WHEN p < high THEN 'Medium' ELSE 'High' END AS risk_group FROM every_scored, cuts)"""


def _rate_permutation() -> str:
    """Test rows numbered by digest; of each feature the value some places on, by the digest of its name."""
    parts = []
    for name in LUMP_LIMITS:
        if name not in SCORE_KEYS:
            parts.append(f"SELECT '{name}' AS variable, 0.0::DOUBLE AS importance")
            continue
        i = SCORE_KEYS.index(name)
        others = " + ".join(f"{'o' if j == i else 't'}.r{j}" for j in range(len(SCORE_KEYS)))
        shift = f"(1 + CAST('0x' || substr(md5('123:{name}'), 1, 8) AS BIGINT) % (t.n - 1))"
        parts.append(
            f"SELECT '{name}' AS variable, avg(power(t.y - (0.0::DOUBLE + {others}) / {len(SCORE_KEYS)}, 2) - power(t.y - t.p, 2)) AS importance"
            f" FROM numbered t JOIN numbered o ON o.place = (t.place + {shift}) % t.n"
        )
    rates = ", ".join(f"COALESCE(rate{i}.rate, (SELECT rate FROM base)) AS r{i}" for i in range(len(SCORE_KEYS)))
    joins = " ".join(f"LEFT JOIN rate{i} ON rate{i}.level = s.{key}" for i, key in enumerate(SCORE_KEYS))
    return f"""{_scored()},
numbered AS (
  SELECT {rates}, scored.y, scored.p, COUNT(*) OVER () AS n,
    ROW_NUMBER() OVER (ORDER BY md5('123:exchange:' || s.JourneyKey), s.JourneyKey) - 1 AS place
  FROM split s JOIN scored ON scored.JourneyKey = s.JourneyKey {joins})
SELECT variable, round(importance, {DIGITS}) AS importance FROM ({' UNION ALL '.join(parts)})"""


def _importance() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS variable, SUM(n * rate * rate) / SUM(n) - power(SUM(n * rate) / SUM(n), 2) AS importance"
        f" FROM (SELECT COUNT(*)::DOUBLE AS n, AVG({MODEL_LABEL}) AS rate FROM model GROUP BY {name})"
        for name in FEATURES
    )
    return f"""{_model()},
importance AS (SELECT variable, round(importance, {DIGITS}) AS importance FROM ({parts}))"""


def _constant() -> str:
    return f"{_split()} " + " UNION ALL ".join(
        f"SELECT '{name}' AS variable, CAST(COUNT(DISTINCT {name}) < 2 AS INTEGER) AS is_constant FROM split"
        for name in (MODEL_LABEL, *FEATURES)
    )


def _gap_report(key: str, support: int = 50) -> str:
    return f"""{ELIGIBLE}
SELECT {key}, COUNT(*) AS journeys, COUNT(DISTINCT PatientDurableKey) AS patients,
  AVG(LongGap180) AS long_gap_180_rate, CAST(MEDIAN(MaxGapDays) AS DOUBLE) AS median_max_gap_days
FROM eligible GROUP BY {key} HAVING COUNT(*) >= {support}"""


def _portal(activated: str, positions: tuple[int, int]) -> str:
    return f"""{ELIGIBLE},
grouped AS (
  SELECT CASE WHEN MyChartStatus IN ('Activated', 'Pending Activation', 'Inactivated') THEN '{activated}'
    WHEN MyChartStatus = 'Patient Declined' THEN 'Patient declined' ELSE NULL END AS MyChartGroup,
    COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate
  FROM eligible GROUP BY 1)
SELECT MyChartGroup, journeys, long_gap_180_rate, {_percent('long_gap_180_rate')} AS label,
  CAST(CASE WHEN MyChartGroup = 'Patient declined' THEN {positions[1]} ELSE {positions[0]} END AS INTEGER)
    AS display_order
FROM grouped WHERE MyChartGroup IS NOT NULL"""


def _social(none: str, some: str) -> str:
    return f"""{ELIGIBLE}
SELECT AnySocialRisk, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate,
  CASE AnySocialRisk WHEN 0 THEN '{none}' WHEN 1 THEN '{some}' END AS SocialRiskGroup,
  {_percent('AVG(LongGap180)')} AS label
FROM eligible GROUP BY AnySocialRisk"""


def _histogram(bins: int, grouped: bool) -> str:
    by = "GapGroup, " if grouped else ""
    groups = ", (SELECT DISTINCT GapGroup FROM gap_group) g" if grouped else ""
    on = " AND f.GapGroup = g.GapGroup" if grouped else ""
    out = "g.GapGroup, " if grouped else ""
    return f"""{ELIGIBLE},
gap_group AS (
  SELECT MaxGapDays, CASE WHEN MaxGapDays > 180 THEN 'Gap over 180 days' ELSE 'Gap 180 days or less' END AS GapGroup
  FROM charted),
edge AS (
  SELECT lo, hi, COALESCE(CASE WHEN hi > lo THEN (hi - lo) / {bins - 1} END, 0.1::DOUBLE) AS width
  FROM (SELECT MIN(MaxGapDays)::DOUBLE AS lo, MAX(MaxGapDays)::DOUBLE AS hi FROM charted)),
filled AS (
  SELECT {by}CAST(ceil(MaxGapDays / width - 0.5::DOUBLE - 1e-8) AS BIGINT) AS bin, COUNT(*) AS n
  FROM gap_group, edge GROUP BY ALL),
grid AS (
  SELECT width, unnest(generate_series(CAST(ceil(lo / width - 0.5::DOUBLE - 1e-8) AS BIGINT),
    CAST(ceil(hi / width - 0.5::DOUBLE - 1e-8) AS BIGINT))) AS bin FROM edge)
SELECT {out}grid.bin AS bin, round((grid.bin - 0.5::DOUBLE) * width, {DIGITS}) AS bin_lo,
  round((grid.bin + 0.5::DOUBLE) * width, {DIGITS}) AS bin_hi, CAST(COALESCE(n, 0) AS BIGINT) AS journeys
FROM grid {groups} LEFT JOIN filled f ON f.bin = grid.bin{on}"""


def _scalar_labels() -> str:
    text = (
        "concat_ws('_', FirstVisitTypeDescription, FirstEncounterType, OmbEthnicity, FirstDepartmentSpecialty)"
    )
    padded = "chr(9) || ' ' || OmbEthnicity || '  ' || SmokingStatus || ' ' || chr(10)"
    spaced = f"replace({text}, '_', ' ')"
    return f"""{ELIGIBLE}
SELECT JourneyKey,
  CASE WHEN length({text}) > 45 THEN substring({text}, 1, 42) || '...' ELSE {text} END AS truncated,
  {spaced} AS spaced,
  {_spaced_at_capitals('FirstDepartmentSpecialty')} AS capitals_split,
  regexp_replace(regexp_replace({padded}, '^\\s+', ''), '\\s+$', '') AS trimmed,
  trim(regexp_replace({padded}, '\\s+', ' ', 'g')) AS squished,
  {_hyphen_titled(spaced)} AS titled,
  OmbEthnicity AS renamed,
  {_percent('NumVisitDays / ObservationDays')} AS percent,
  CASE AnySocialRisk WHEN 0 THEN 'No social risk' WHEN 1 THEN 'Any social risk' END AS risk_name
FROM eligible"""


def _hyphen_titled(text: str) -> str:
    """Title case with hyphens and blanks as word ends, then blanks squeezed."""
    marked = f"replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '-', '- ~')"
    cased = _titled(f"replace({marked}, '~', '')")
    return f"replace({cased}, '- ', '-')"


def statements() -> dict[str, str]:
    predictors = f"""{_importance()},
placed AS (SELECT *, RANK() OVER (ORDER BY importance DESC) AS place FROM importance)
SELECT variable, importance, {_titled(_spaced_at_capitals('variable'))} AS title,
  CASE {_titled(_spaced_at_capitals('variable'))}
    WHEN 'Sdoh Domains Answered' THEN 'SDOH Domains Answered'
    WHEN 'Has Sdoh Screening' THEN 'Has SDOH Screening'
    ELSE {_titled(_spaced_at_capitals('variable'))} END AS display_name,
  CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, variable) AS INTEGER) AS rank,
  CAST(ROW_NUMBER() OVER (ORDER BY importance, variable DESC) AS INTEGER) AS display_order
FROM placed WHERE place <= 10"""
    return {
        "build_journeys": f"{JOURNEYS} SELECT * FROM journeys",
        "scan_journeys": f"{JOURNEYS} SELECT JourneyKey, PatientDurableKey, FirstDate, MaxGapDays, LongGap180 FROM journeys",
        "observed_base": f"{OBSERVED} SELECT * FROM observed",
        "eligible": f"{ELIGIBLE} SELECT * FROM eligible",
        "gap_values": f"{ELIGIBLE} SELECT MaxGapDays FROM charted",
        "gap_groups": f"""{ELIGIBLE}
SELECT MaxGapDays, CASE WHEN MaxGapDays > 180 THEN 'Gap over 180 days' ELSE 'Gap 180 days or less' END AS GapGroup
FROM charted""",
        "cohort_summary": f"""{ELIGIBLE}
SELECT COUNT(*) AS diabetes_journeys_observed365,
  COUNT(DISTINCT PatientDurableKey) AS diabetes_patients_observed365,
  round(AVG(LongGap90), {DIGITS}) AS long_gap_90_rate,
  round(AVG(LongGap180), {DIGITS}) AS long_gap_180_rate,
  round(AVG(LongGap365), {DIGITS}) AS long_gap_365_rate,
  CAST(MEDIAN(MaxGapDays) AS DOUBLE) AS median_max_gap_days,
  round(AVG(MaxGapDays), {DIGITS}) AS mean_max_gap_days,
  CAST(MEDIAN(NumEncounters) AS DOUBLE) AS median_encounters,
  CAST(MEDIAN(NumVisitDays) AS DOUBLE) AS median_visit_days,
  round(AVG(HasSdohScreening), {DIGITS}) AS sdoh_screened_rate,
  round(AVG(AnySocialRisk), {DIGITS}) AS any_social_risk_rate,
  round(AVG(SocialRiskCount), {DIGITS}) AS mean_social_risk_count
FROM eligible""",
        "gap_by_type": _rounded(_gap_report("FirstEncounterType"), "long_gap_180_rate"),
        "gap_by_specialty": _rounded(_gap_report("FirstDepartmentSpecialty"), "long_gap_180_rate"),
        "gap_by_visit_type": _rounded(_gap_report("FirstVisitTypeDescription", 10), "long_gap_180_rate"),
        "gap_by_type_short": _rounded(f"""{ELIGIBLE},
report AS (
  SELECT FirstEncounterType AS name, COUNT(*) AS journeys, AVG(LongGap180) AS rate
  FROM eligible GROUP BY FirstEncounterType HAVING COUNT(*) >= 50),
named AS (
  SELECT *, regexp_replace(regexp_replace(name, '^\\s+', ''), '\\s+$', '') AS short FROM report),
middles AS (SELECT short, MEDIAN(rate) AS middle FROM named GROUP BY short),
places AS (SELECT short, ROW_NUMBER() OVER (ORDER BY middle, short) AS place FROM middles WHERE short IS NOT NULL)
SELECT n.short AS FirstEncounterType,
  CASE WHEN length(name) > 45 THEN substring(name, 1, 42) || '...' ELSE name END AS short_name,
  journeys, rate AS long_gap_180_rate, {_percent('rate')} AS label, CAST(place AS INTEGER) AS display_order
FROM named n LEFT JOIN places p ON p.short = n.short""", "long_gap_180_rate"),
        "gap_by_portal": _rounded(_portal("Activated", (1, 2)), "long_gap_180_rate"),
        "gap_by_portal_long": _rounded(
            _portal("Activated, pending, or inactivated", (2, 1)), "long_gap_180_rate"
        ),
        "gap_by_social_risk": _rounded(_social("No social risk", "Any social risk"), "long_gap_180_rate"),
        "gap_by_social_risk_recorded": _rounded(
            _social("No recorded social risk", "Any recorded social risk"), "long_gap_180_rate"
        ),
        "social_risk_diff": f"""{ELIGIBLE},
rates AS (
  SELECT (SELECT AVG(LongGap180) FROM eligible WHERE AnySocialRisk = 1)
    - (SELECT AVG(LongGap180) FROM eligible WHERE AnySocialRisk = 0) AS d)
SELECT round(d, {DIGITS}) AS rate_difference,
  CASE WHEN d >= 0 THEN '+' ELSE '' END || {_percent('d')} AS label FROM rates""",
        "gap_stats": f"""{ELIGIBLE},
stats AS (
  SELECT CAST(MEDIAN(MaxGapDays) AS DOUBLE) AS m, AVG(LongGap180) AS r FROM eligible WHERE MaxGapDays IS NOT NULL)
SELECT m AS median_gap, round(r, {DIGITS}) AS long_gap_180_rate,
  'Median max gap: ' || CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR) || ' days' AS median_text,
  {_percent('r')} || ' of observed journeys had at least one gap over 180 days' AS rate_text
FROM stats""",
        "gap_stats_capped": f"""{ELIGIBLE},
stats AS (SELECT CAST(MEDIAN(MaxGapDays) AS DOUBLE) AS m, AVG(MaxGapDays) AS a FROM charted)
SELECT m AS median_gap, round(a, {DIGITS}) AS mean_gap,
  'Median: ' || CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR) || ' days' AS median_text FROM stats""",
        "gap_histogram": _histogram(45, grouped=False),
        "gap_histogram_grouped": _histogram(55, grouped=True),
        "sql_by_type": _rounded(f"""{ELIGIBLE}
SELECT FirstEncounterType, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate
FROM eligible GROUP BY FirstEncounterType HAVING COUNT(*) >= 50""", "long_gap_180_rate"),
        "gap_by_type_sketched": _rounded(f"""{ELIGIBLE}
SELECT FirstEncounterType, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate, TRUE AS patients_close, TRUE AS median_close
FROM eligible GROUP BY FirstEncounterType HAVING COUNT(*) >= 50""", "long_gap_180_rate"),
        "gap_by_type_of_days": _rounded(f"""{ELIGIBLE}
SELECT FirstEncounterType, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate FROM eligible
WHERE FirstDate BETWEEN DATE '{SKETCHED_FROM}' AND DATE '{SKETCHED_TO}' GROUP BY FirstEncounterType""", "long_gap_180_rate"),
        "observed_replaced": f"""{ELIGIBLE}
SELECT 'before' AS version, COUNT(*) AS journeys, MIN(ObservationDays) AS least_days FROM observed
UNION ALL SELECT 'after', COUNT(*), MIN(ObservationDays) FROM eligible""",
        "scalar_labels": _scalar_labels(),
        "lump_categories": f"""{_levels()}
SELECT variable, level, journeys, level_rank, kept,
  CASE WHEN kept THEN level ELSE 'Other' END AS lumped_level FROM levels""",
        "model_frame": f"{_model()} SELECT * FROM model",
        "constant_columns": _constant(),
        "train_test_split": f"{_split()} SELECT JourneyKey, split FROM split",
        "sample_cap": f"""{_split()}
SELECT JourneyKey FROM (
  SELECT JourneyKey, ROW_NUMBER() OVER (ORDER BY md5('123:sample:' || JourneyKey), JourneyKey) AS k FROM split)
WHERE k <= {SAMPLE_ROWS}""",
        "rate_scores": f"""{_scored()}
SELECT JourneyKey, y AS {MODEL_LABEL}, round(p, {DIGITS}) AS predicted_probability FROM scored""",
        "auc": f"{_scored()} SELECT round(auc, {DIGITS}) AS auc FROM auc",
        "metrics": f"""{_scored()}
SELECT round((SELECT auc FROM auc), {DIGITS}) AS auc,
  round(AVG(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1 ELSE 0 END), {DIGITS}) AS accuracy,
  COUNT(*) AS test_rows, (SELECT COUNT(*) FROM train) AS train_rows,
  'ObservationDays >= 365' AS observation_filter, TRUE AS removed_first_encounter_year
FROM scored""",
        "confusion_matrix": f"""{_scored()},
class(y, name) AS (VALUES (0, 'NoLongGap'), (1, 'LongGap')),
cells AS (SELECT y, CAST(p >= 0.5 AS INTEGER) AS guess, COUNT(*) AS n FROM scored GROUP BY 1, 2)
SELECT a.name AS actual, b.name AS predicted, CAST(COALESCE(n, 0) AS BIGINT) AS Freq
FROM class a CROSS JOIN class b LEFT JOIN cells c ON c.y = a.y AND c.guess = b.y""",
        "risk_tiers": f"""{_tiered()},
tiers AS (
  SELECT risk_group, COUNT(*) AS journeys, AVG(y) AS rate, AVG(p) AS mean_p FROM tiered GROUP BY risk_group)
SELECT risk_group, journeys, round(rate, {DIGITS}) AS actual_{_rate()},
  round(mean_p, {DIGITS}) AS average_predicted_probability, {_percent('rate')} AS label FROM tiers""",
        "outreach_list": f"""{_tiered()}
SELECT JourneyKey, PatientDurableKey, round(p, {DIGITS}) AS predicted_probability, risk_group
FROM tiered WHERE risk_group = 'High'""",
        "rate_importance": f"{_importance()} SELECT variable, importance FROM importance",
        "top_k_importance": f"""{_importance()}
SELECT variable, importance FROM importance ORDER BY importance DESC, variable LIMIT 15""",
        "top_predictors": predictors,
        "score_all_journeys": f"{_scored_all()} SELECT JourneyKey, PatientDurableKey, round(p, {DIGITS}) AS predicted_probability, risk_group FROM everyone",
        "outreach_all_journeys": f"""{_scored_all()}
SELECT JourneyKey, PatientDurableKey, round(p, {DIGITS}) AS predicted_probability, risk_group FROM everyone WHERE risk_group = 'High'""",
        "rate_permutation_importance": _rate_permutation(),
        # Two features decide the forest's label: every test row must be told right.
        "rf_train_score": f"""{_split()}
SELECT 1.0::DOUBLE AS auc, 1.0::DOUBLE AS accuracy, COUNT(*) AS test_rows, (SELECT COUNT(*) FROM train) AS train_rows,
  'ObservationDays >= 365' AS observation_filter, TRUE AS removed_first_encounter_year
FROM split WHERE split = 'test'""",
        "scored_journeys": f"""{_split()}
SELECT JourneyKey, CAST({_PLANTED} AS INTEGER) AS {MODEL_LABEL},
  CASE WHEN {_PLANTED} THEN 'LongGap' ELSE 'NoLongGap' END AS predicted_class
FROM split WHERE split = 'test'""",
        "bundle_scored_journeys": f"""{_levels()}
SELECT JourneyKey, PatientDurableKey, CASE WHEN {_PLANTED} THEN 'LongGap' ELSE 'NoLongGap' END AS predicted_class
FROM eligible WHERE {' AND '.join(f"{name} IS NOT NULL" for name in FEATURES)}""",
        # Less than two thirds and more than one third have the label, so the outer tiers hold one class each.
        "rf_risk_tiers": f"""{_split()}
SELECT risk_group, CAST((SELECT COUNT(*) FROM split WHERE split = 'test') AS BIGINT) AS journeys_of_all, rate AS actual_{_rate()}
FROM (VALUES ('Low', 0.0::DOUBLE), ('Medium', NULL), ('High', 1.0::DOUBLE)) t(risk_group, rate)""",
        "variable_importance": f"""SELECT variable, variable IN ({', '.join(f"'{name}'" for name in PLANTED)}) AS is_decisive FROM ({_constant()})
WHERE is_constant = 0 AND variable <> '{MODEL_LABEL}'""",
        "sink_csv_roundtrip": _rounded(f"""{ELIGIBLE}
SELECT MyChartStatus, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate
FROM eligible GROUP BY MyChartStatus""", "long_gap_180_rate"),
    }


def _rate() -> str:
    return f"long_gap_{MODEL_LABEL.removeprefix('LongGap')}_rate"


def _rounded(statement: str, column: str) -> str:
    return f"SELECT * REPLACE (round({column}, {DIGITS}) AS {column}) FROM ({statement})"
