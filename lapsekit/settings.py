"""Column lists and default parameters of the journey analysis."""

from __future__ import annotations

from datetime import date

# The columns, limits, labels and texts below are part of the
# results' meaning, so they are stated once, here, as plain values.

OBSERVATION_END = date(2025, 12, 31)
MIN_OBSERVATION_DAYS = 365
GAP_THRESHOLDS = (90, 180, 365)
MIN_SUPPORT = 50
MAX_CHARTED_GAP = 1460
SEED = 123
TRAIN_FRACTION = 0.75

PATIENT = "PatientDurableKey"
JOURNEY = "JourneyKey"
LABEL = "LongGap180"

# Categorical feature -> number of most frequent levels kept as they are.
LUMP_LIMITS = {
    "FirstEncounterType": 20,
    "FirstVisitTypeDescription": 30,
    "FirstDepartmentType": 10,
    "FirstDepartmentSpecialty": 30,
    "PatientBirthYearBin": 25,
    "SexAssignedAtBirth": 10,
    "OmbRace": 15,
    "OmbEthnicity": 10,
    "MyChartStatus": 15,
    "SmokingStatus": 15,
}
OTHER_LEVEL = "Other"

RISK_DOMAINS = (
    "TransportationRisk",
    "FoodRisk",
    "HousingRisk",
    "FinancialRisk",
    "StressRisk",
    "DepressionRisk",
    "SocialConnectionRisk",
    "UtilitiesRisk",
)
BINARY_FEATURES = ("HasSdohScreening", "AnySocialRisk", *RISK_DOMAINS)
NUMERIC_FEATURES = ("SdohDomainsAnswered", "SocialRiskCount")
FEATURES = (*LUMP_LIMITS, *BINARY_FEATURES, *NUMERIC_FEATURES)

LABEL_NAMES = {0: "NoLongGap", 1: "LongGap"}
CLASS_CUTOFF = 0.5
RISK_TIERS = ("Low", "Medium", "High")

# Portal status -> report group; a status not listed has no group.
PORTAL_GROUPS_SHORT = {
    "Activated": "Activated",
    "Pending Activation": "Activated",
    "Inactivated": "Activated",
    "Patient Declined": "Patient declined",
}
PORTAL_GROUPS_LONG = {
    "Activated": "Activated, pending, or inactivated",
    "Pending Activation": "Activated, pending, or inactivated",
    "Inactivated": "Activated, pending, or inactivated",
    "Patient Declined": "Patient declined",
}
# Chart order of the groups.
PORTAL_ORDER_SHORT = ("Activated", "Patient declined")
PORTAL_ORDER_LONG = ("Patient declined", "Activated, pending, or inactivated")

SOCIAL_RISK_NAMES = {0: "No social risk", 1: "Any social risk"}
SOCIAL_RISK_NAMES_RECORDED = {0: "No recorded social risk", 1: "Any recorded social risk"}

GAP_GROUP_OVER = "Gap over 180 days"
GAP_GROUP_WITHIN = "Gap 180 days or less"

PREDICTOR_RENAMES = {
    "Sdoh Domains Answered": "SDOH Domains Answered",
    "Has Sdoh Screening": "Has SDOH Screening",
}

# Bin counts of the two gap histograms.
HISTOGRAM_BINS = 45
GROUPED_HISTOGRAM_BINS = 55


def rate_name(label: str) -> str:
    """Column name of a gap rate: ``LongGap180`` -> ``long_gap_180_rate``."""
    return f"long_gap_{label.removeprefix('LongGap')}_rate"
