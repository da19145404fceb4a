"""Word lists, tables, patterns and thresholds that results depend on."""

# --- fixed values: routing -------------------------------------------------
CRITICAL_KEYWORDS = [
    "chest pain", "difficulty breathing", "unconscious", "seizure",
    "severe bleeding", "anaphylaxis", "stroke", "cardiac arrest",
    "respiratory failure", "sepsis", "trauma", "suicidal",
]

LOW_TIER = "claude-haiku-4-5-20241022"
MIDDLE_TIER = "claude-sonnet-4-5-20250929"
TOP_TIER = "claude-opus-4-6-20250929"
MODEL_TIERS = [LOW_TIER, MIDDLE_TIER, TOP_TIER]

# category -> (default tier rank, escalation threshold, safety flagged)
CATEGORY_ROUTING = {
    "routine_vitals": (0, 0.65, False),
    "chronic_management": (0, 0.6, False),
    "symptom_assessment": (1, 0.55, True),
    "medication_review": (1, 0.5, True),
    "diagnostic_interpretation": (1, 0.45, True),
    "acute_presentation": (2, 0.0, True),
    "critical_emergency": (2, 0.0, True),
    "mental_health": (2, 0.0, True),
    "pediatric": (2, 0.0, True),
    "surgical_consult": (2, 0.0, True),
}
MIN_ROUTING_CONFIDENCE = 0.70

# model -> USD per million tokens (input, output)
MODEL_PRICES = {
    LOW_TIER: (1.0, 5.0),
    MIDDLE_TIER: (3.0, 15.0),
    TOP_TIER: (15.0, 75.0),
}

# --- fixed values: safety check --------------------------------------------
HALLUCINATION_THRESHOLD = 0.15
CONFIDENCE_THRESHOLD = 0.85
MAX_RETRIES = 2
NODES = ["extractor", "reasoner", "sentinel"]
STEP_NODES = ["classifier", "extractor", "reasoner", "sentinel"]
VALIDATION_TYPES = ["input", "output", "audit"]
TRIAGE_LEVELS = ["Emergency", "Urgent", "Semi-Urgent", "Non-Urgent"]
SOURCE_TYPES = ["hospital_curated", "fhir_public"]
APPROVAL_DECISIONS = ["approved", "rejected"]
APPROVAL_STATUSES = ["pending", "approved", "rejected", "escalated"]

# --- fixed values: text limits and patterns --------------------------------
MIN_TEXT_CHARS, MAX_TEXT_CHARS = 10, 50_000
TOKEN_LIMITS = {"input": (5, 50_000), "output": (10, 8_192)}
SUMMARY_CHARS = 500

PII_TAG = "[REDACTED]"
PHI_TAG = "***PHI_REDACTED***"

_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_DATE = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
_PHONE = r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"

PII_PATTERNS = [
    ("SSN", _SSN),
    ("MRN", r"\b(?:MRN|mrn)[:\s#]*\d{6,10}\b"),
    ("EMAIL", _EMAIL),
    ("DOB", r"\b(?:DOB|dob|Date of Birth|date of birth)[:\s]*" + _DATE),
    ("PHONE", _PHONE),
]

# same five types; medical record number and birth date match in any case
PII_PATTERNS_ANY_CASE = [
    ("SSN", _SSN),
    ("MRN", r"(?i)\b(?:MRN)[:\s#]*\d{6,10}\b"),
    ("EMAIL", _EMAIL),
    ("DOB", r"(?i)\b(?:DOB|Date of Birth)[:\s]*" + _DATE),
    ("PHONE", _PHONE),
]

PHI_PATTERNS = PII_PATTERNS + [
    ("PATIENT_NAME", r"(?:Patient|Pt|patient|pt)[:\s]+([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,2})"),
    ("PROVIDER_NAME", r"(?:Dr\.|Dr|MD|NP|PA|RN)[:\s]+([A-Z][a-z]+(?:\s[A-Z][a-z]+){0,2})"),
    ("ADDRESS", r"\b\d{1,5}\s(?:[A-Z][a-z]+\s){1,3}(?:St|Ave|Blvd|Dr|Ln|Rd|Ct|Way|Pl)(?:\.|\b)"),
]

INJECTION_PATTERNS = [
    r"ignore\s+(?:all\s+)?previous\s+instructions",
    r"you\s+are\s+now\s+(?:a\s+)?(?:different|new)\s+(?:ai|assistant|model)",
    r"system\s*:\s*you\s+are",
    r"<\s*(?:system|admin|root)\s*>",
    r"IGNORE\s+ALL\s+RULES",
    r"override\s+(?:safety|content)\s+(?:filter|policy)",
]

SCANNER_AGENTS = ["sqlmap", "nikto", "nmap", "masscan", "dirbuster"]
OVERDUE_LOG_PATTERN = r"approval.*overdue|sla.*exceeded|pending.*expired"

# --- fixed values: JSON schemas of the three node outputs -------------------
_NULLABLE_NUMBER = {"type": ["number", "null"]}
_NULLABLE_STRING = {"type": ["string", "null"]}
_STRING = {"type": "string"}
_STRINGS = {"type": "array", "items": {"type": "string"}}
_UNIT_NUMBER = {"type": "number", "minimum": 0.0, "maximum": 1.0}
_VITALS = ["heart_rate", "blood_pressure", "temperature", "respiratory_rate", "spo2"]

NODE_SCHEMAS = {
    "extractor": {
        "type": "object",
        "required": ["vitals", "symptoms", "medications", "history", "chief_complaint"],
        "properties": {
            "vitals": {
                "type": "object",
                "properties": {
                    "heart_rate": _NULLABLE_NUMBER,
                    "blood_pressure": _NULLABLE_STRING,
                    "temperature": _NULLABLE_NUMBER,
                    "respiratory_rate": _NULLABLE_NUMBER,
                    "spo2": _NULLABLE_NUMBER,
                },
                "required": _VITALS,
            },
            "symptoms": {
                "type": "array",
                "items": {
                    "type": "object",
                    "required": ["description"],
                    "properties": {
                        "description": _STRING,
                        "onset": _NULLABLE_STRING,
                        "severity": _NULLABLE_STRING,
                    },
                },
            },
            "medications": {
                "type": "array",
                "items": {
                    "type": "object",
                    "required": ["name"],
                    "properties": {
                        "name": _STRING,
                        "dose": _NULLABLE_STRING,
                        "frequency": _NULLABLE_STRING,
                    },
                },
            },
            "history": {
                "type": "object",
                "properties": {"conditions": _STRINGS, "allergies": _STRINGS, "surgeries": _STRINGS},
                "required": ["conditions", "allergies", "surgeries"],
            },
            "chief_complaint": _NULLABLE_STRING,
            "assessment_notes": _NULLABLE_STRING,
        },
    },
    "reasoner": {
        "type": "object",
        "required": ["level", "confidence", "reasoning_summary"],
        "properties": {
            "level": {"type": "string", "enum": TRIAGE_LEVELS},
            "confidence": _UNIT_NUMBER,
            "reasoning_summary": {"type": "string", "minLength": 1},
            "recommended_actions": _STRINGS,
            "key_findings": _STRINGS,
        },
    },
    "sentinel": {
        "type": "object",
        "required": ["hallucination_score", "confidence_assessment", "vitals_consistent", "medication_safe"],
        "properties": {
            "hallucination_score": _UNIT_NUMBER,
            "confidence_assessment": _UNIT_NUMBER,
            "vitals_consistent": {"type": "boolean"},
            "medication_safe": {"type": "boolean"},
            "issues_found": _STRINGS,
        },
    },
}
MAX_SCHEMA_ERRORS = 5

# --- fixed values: retrieval -------------------------------------------------
TOP_K = 5
EMBEDDING_DIM = 1024

# --- fixed values: topics, delivery and escalation ---------------------------
MAX_DELIVERY_ATTEMPTS = 5
MESSAGE_RETENTION_SECONDS = 604_800
FLUSH_ROWS, FLUSH_SECONDS = 50, 5
DLQ_SEVERITY = {
    "triage-completed-dlq": "P1",
    "audit-events-dlq": "P2",
    "triage-approved-dlq": "P3",
}
# age upper bound in hours -> stage
ESCALATION_STAGES = [
    (1, "on_call_engineer"),
    (4, "platform_team_lead"),
    (12, "engineering_manager_and_compliance"),
    (24, "vp_engineering_and_privacy_officer"),
]
ESCALATION_BREACH = "sla_breach"
LOG_SEVERITIES = ["DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]

# --- fixed values: service levels, alerts and rate limits --------------------
SLO_AVAILABILITY = 0.995
SLO_LATENCY = 0.95
SLO_LATENCY_MS = 3000.0
SLO_DAYS = 30
FAST_BURN, SLOW_BURN = (60, 14.4), (360, 6.0)
ERROR_RATE_PERCENT = 5.0
P99_LATENCY_MS = 5000.0
DAILY_COST_USD = {"default": 50.0, "prod": 200.0}
RATE_LIMITS_PER_MINUTE = {"triage": 100, "health": 200, "push": 200, "stream": 50, "approve": 60}
EDGE_LIMIT, EDGE_BAN_SECONDS = (500, 60), 60
SESSION_FEED_ROWS = 50
