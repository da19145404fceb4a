"""Table and message schemas as DDL. Nothing is ever inferred from data."""

ENCOUNTERS_JSON = ("encounter_text STRING, patient_id STRING, category STRING")

ENVELOPE = (
    "message STRUCT<data: STRING, message_id: STRING, publish_time: STRING>, subscription STRING"
)

PROTOCOLS = (
    "id STRING, title STRING, content STRING, embedding ARRAY<FLOAT>, source_type STRING, "
    "specialty STRING, effective_date DATE, expiry_date DATE, version INT, hospital_id STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

AUDIT_TRAIL = (
    "encounter_id STRING, node_name STRING, model_used STRING, routing_category STRING, "
    "routing_confidence DOUBLE, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE, "
    "reasoning_snapshot STRING, compliance_flags ARRAY<STRING>, sentinel_hallucination_score DOUBLE, "
    "sentinel_confidence_score DOUBLE, circuit_breaker_tripped BOOLEAN, duration_ms BIGINT, "
    "created_at TIMESTAMP"
)

CLASSIFIER_FEEDBACK = (
    "encounter_id STRING, original_category STRING, corrected_category STRING, "
    "classifier_confidence DOUBLE, reviewer_id STRING, created_at TIMESTAMP"
)

TRIAGE_APPROVALS = (
    "id STRING, encounter_id STRING, triage_level STRING, confidence_score DECIMAL(4,3), "
    "reasoning_summary STRING, status STRING, clinician_id STRING, clinician_notes STRING, "
    "submitted_at TIMESTAMP, reviewed_at TIMESTAMP, sla_deadline TIMESTAMP"
)

ENCOUNTER_AUDIT = (
    "id STRING, encounter_id STRING, patient_id_encrypted STRING, node_name STRING, model_used STRING, "
    "input_tokens INT, output_tokens INT, cost_usd DECIMAL(10,8), reasoning_snapshot STRING, "
    "compliance_flags ARRAY<STRING>, duration_ms INT, created_at TIMESTAMP"
)

# columns that must not be null, and keys that must be unique
REQUIRED = {
    "audit_trail": ["encounter_id", "node_name", "model_used", "created_at"],
    "classifier_feedback": ["encounter_id", "original_category", "corrected_category", "reviewer_id", "created_at"],
    "clinical_protocols": ["id", "title", "content", "source_type"],
    "triage_approvals": ["id", "encounter_id", "triage_level", "status"],
}
UNIQUE = {
    "clinical_protocols": [["id"]],
    "triage_approvals": [["id"], ["encounter_id"]],
}

EXTRACTION_SYMPTOMS = "ARRAY<STRUCT<description: STRING, onset: STRING, severity: STRING>>"
EXTRACTION_MEDICATIONS = "ARRAY<STRUCT<name: STRING, dose: STRING, frequency: STRING>>"
