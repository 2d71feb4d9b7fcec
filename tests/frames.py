"""Hand-made frames for the tests."""

from datetime import date

from lapsekit.settings import BINARY_FEATURES, FEATURES, LUMP_LIMITS

ENCOUNTERS = (
    "PatientDurableKey bigint, JourneyPart string, VisitDate date, EncounterKey bigint, EncounterLine int,"
    " DepartmentKey bigint, DepartmentType string, EncounterType string, SmokingStatus string"
)
JOURNEYS = (
    "JourneyKey string, PatientDurableKey bigint, FirstEncounterType string, MyChartStatus string,"
    " AnySocialRisk int, LongGap90 int, LongGap180 int, LongGap365 int, MaxGapDays int,"
    " NumEncounters bigint, NumVisitDays bigint, HasSdohScreening int, SocialRiskCount int"
)
MODEL = "JourneyKey string, PatientDurableKey bigint, LongGap180 int, " + ", ".join(
    f"{name} {'string' if name in LUMP_LIMITS else 'int'}" for name in FEATURES
)


def encounters(spark, visits):
    """Encounters of (patient, part, day as text); keys count up unless given."""
    rows = []
    for i, (patient, part, day, *rest) in enumerate(visits):
        key, line = rest if rest else (100 + i, 1)
        rows.append((patient, part, date.fromisoformat(day) if day else None, key, line, 7, "A", f"type-{key}-{line}", "F"))
    return spark.createDataFrame(rows, ENCOUNTERS)


def journeys(spark, rows):
    """Journeys of (patient, type, status, risk, gap days)."""
    out = []
    for i, (patient, kind, status, risk, gap) in enumerate(rows):
        flags = [None if gap is None else int(gap > n) for n in (90, 180, 365)]
        out.append((f"j{i}", patient, kind, status, risk, *flags, gap, 3 + i, 2 + i, risk, risk))
    return spark.createDataFrame(out, JOURNEYS)


def model_rows(spark, n, label, **columns):
    """Model rows; label and columns are functions of the row number."""
    rows = []
    for i in range(n):
        values = {name: ("x" if name in LUMP_LIMITS else 0) for name in FEATURES}
        values.update({name: f(i) for name, f in columns.items()})
        rows.append((f"j{i:05d}", i // 2, label(i), *(values[name] for name in FEATURES)))
    return spark.createDataFrame(rows, MODEL)


assert set(BINARY_FEATURES) <= set(FEATURES)
