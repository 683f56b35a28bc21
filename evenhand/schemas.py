"""Table schemas and the fixed values every operator shares."""

from pyspark.sql import types as T

# Metric names in report order, breach thresholds, and whether a
# metric is breached above its threshold (True) or below it (False).
METRIC_THRESHOLDS = {
    "demographic_parity_difference": 0.10,
    "equalized_odds_difference": 0.08,
    "equal_opportunity_difference": 0.05,
    "disparate_impact_ratio": 0.80,
    "average_odds_difference": 0.07,
    "statistical_parity_subgroup_lift": 1.25,
    "predictive_parity_difference": 0.08,
    "calibration_gap": 0.05,
    "individual_fairness_score": 0.85,
    "counterfactual_fairness": 0.06,
    "intersectional_bias_score": 0.12,
    "temporal_drift_index": 5.0,
}
BREACHED_BELOW = ("disparate_impact_ratio", "individual_fairness_score")

# Severities, worst first, and their gauge numbers.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "PASS")
SEVERITY_GAUGE = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "PASS": 0}

# Action, delay in seconds, notify, log to warehouse, log to ledger.
SEVERITY_ACTIONS = {
    "CRITICAL": ("TRIGGER_PIPELINE", 0, True, True, True),
    "HIGH": ("QUEUE_PIPELINE", 3600, True, True, True),
    "MEDIUM": ("LOG_AND_HIGHLIGHT", None, False, True, True),
    "LOW": ("LOG_ONLY", None, False, False, True),
    "PASS": ("LOG_CLEAN", None, False, True, True),
}

# Compliance verdict per severity.
VERDICTS = {
    "CRITICAL": "NON-COMPLIANT — Immediate action required",
    "HIGH": "NON-COMPLIANT — Action required within 24 hours",
    "MEDIUM": "REQUIRES MONITORING — Schedule mitigation review",
    "LOW": "COMPLIANT — Statistical noise detected, monitor trend",
    "PASS": "COMPLIANT — All fairness thresholds satisfied",
}

# Privileged group of the attributes that have one by convention.
PRIVILEGED_GROUPS = {
    "sex": "Male",
    "gender": "Male",
    "race": "White",
    "age_bin": "AGE_30_40",
}

# Demographic vocabularies.
GENDER_CODES = {
    "M": "MALE",
    "F": "FEMALE",
    "male": "MALE",
    "female": "FEMALE",
    "Male": "MALE",
    "Female": "FEMALE",
    "0": "MALE",
    "1": "FEMALE",
    "m": "MALE",
    "f": "FEMALE",
}
RACE_CODES = {
    "White": "WHITE",
    "Black": "BLACK",
    "Asian-Pac-Islander": "ASIAN_PACIFIC",
    "Amer-Indian-Eskimo": "NATIVE_AMERICAN",
    "Other": "OTHER",
    "white": "WHITE",
    "black": "BLACK",
    "asian": "ASIAN_PACIFIC",
    "hispanic": "HISPANIC",
}
AGE_BINS = (
    (0, 18, "AGE_UNDER_18"),
    (18, 30, "AGE_18_30"),
    (30, 40, "AGE_30_40"),
    (40, 50, "AGE_40_50"),
    (50, 60, "AGE_50_60"),
    (60, 999, "AGE_60_PLUS"),
)
SEX_SPELLINGS = {"M": "Male", "male": "Male", "F": "Female", "female": "Female"}

# Feature keys that may hold each demographic value.
GENDER_KEYS = ("sex", "gender", "Sex", "Gender")
AGE_KEYS = ("age", "Age", "AGE")
RACE_KEYS = ("race", "Race", "ethnicity", "Ethnicity")
ZIP_KEYS = ("zip_code", "zipcode", "zip", "postal_code")
SENSITIVE_FEATURES = ("sex", "gender", "race", "age", "ethnicity", "zip_code")

# Allowed use cases, ledger event types and mitigation statuses.
USE_CASES = (
    "hiring",
    "lending",
    "healthcare",
    "criminal_justice",
    "content_recommendation",
)
LEDGER_EVENT_TYPES = (
    "AUDIT_COMPLETED",
    "MITIGATION_TRIGGERED",
    "MITIGATION_COMPLETED",
    "MODEL_PROMOTED",
    "BIAS_ALERT_SENT",
)
MITIGATION_STATUSES = ("queued", "in_progress", "success", "failed", "rolled_back")
MITIGATION_STAGES = ("pre-processing", "in-processing", "post-processing", "retraining")

MAX_BATCH_EVENTS = 500
MIN_SAMPLE_SIZE = 100
SIGNIFICANCE = 0.05


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D, _L, _B, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)

# Incoming event. Fields that must be text are read as variants, which still know
# text from numbers and null from absent; numbers and times stay text, so that a
# bad value is reported by its rule instead of voiding the whole record.
_V = T.VariantType()
EVENT_JSON = _struct(
    event_id=_V,
    model_id=_V,
    model_version=_V,
    timestamp=_S,
    features=_S,
    prediction=_struct(label=_V, score=_S, threshold=_S),
    ground_truth=_V,
    demographic_tags=T.ArrayType(_S),
    session_context=_struct(tenant_id=_V, use_case=_V),
)

PREDICTIONS = _struct(
    event_id=_S,
    model_id=_S,
    model_version=_S,
    timestamp=_TS,
    features=_S,
    prediction_label=_S,
    prediction_score=_D,
    prediction_threshold=_D,
    ground_truth=_S,
    demographic_tags=T.ArrayType(_S),
    tenant_id=_S,
    use_case=_S,
    ingested_at=_TS,
)

DEMOGRAPHICS = _struct(
    event_id=_S,
    model_id=_S,
    timestamp=_TS,
    gender_distribution=_S,
    race_distribution=_S,
    age_bin=_S,
    income_bracket=_S,
    proxy_quality_score=_D,
    is_proxy=_B,
    zip_code=_S,
    enriched_at=_TS,
)

DEAD_LETTERS = _struct(
    original_message=_S,
    error_type=_S,
    error_message=_S,
    failed_at=_TS,
)

METRIC = _struct(
    name=_S,
    value=_D,
    threshold=_D,
    breached=_B,
    confidence_interval=T.ArrayType(_D),
    severity=_S,
    groups_compared=T.ArrayType(_S),
    sample_sizes=T.ArrayType(_L),
    p_value=_D,
)
SLICE = _struct(
    attribute=_S,
    group_value=_S,
    count=_L,
    positive_rate=_D,
    metrics=T.MapType(_S, _D),
)
BIAS_AUDITS = _struct(
    audit_id=_S,
    model_id=_S,
    model_version=_S,
    audit_timestamp=_TS,
    window_start=_TS,
    window_end=_TS,
    sample_size=_L,
    overall_severity=_S,
    metrics=_S,
    demographic_slices=_S,
    protected_attributes=T.ArrayType(_S),
    triggered_mitigation=_B,
    mitigation_id=_S,
    created_at=_TS,
)
TIMESERIES = _struct(
    model_id=_S, metric_name=_S, metric_value=_D, severity=_S, recorded_at=_TS
)
MITIGATION_LOG = _struct(
    mitigation_id=_S,
    audit_id=_S,
    model_id=_S,
    model_version_before=_S,
    model_version_after=_S,
    triggered_at=_TS,
    algorithm_used=_S,
    stage=_S,
    metrics_before=T.MapType(_S, _D),
    metrics_after=T.MapType(_S, _D),
    accuracy_before=_D,
    accuracy_after=_D,
    accuracy_delta=_D,
    status=_S,
    promoted_to_production=_B,
    pipeline_run_id=_S,
    error_message=_S,
)
LEDGER = _struct(
    EventId=_S,
    EventType=_S,
    ModelId=_S,
    TenantId=_S,
    EventTimestamp=_TS,
    Payload=_S,
    ActorServiceId=_S,
    IpAddress=_S,
)
