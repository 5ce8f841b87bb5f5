"""Fixed vocabularies and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Statuses, stages, routes and field names as they are stored.
ITEM_STATUSES = ["open", "in_progress", "completed", "cancelled", "deferred"]
IMPLIED_STATUSES = ["completed", "in_progress", "cancelled", "deferred"]
RELATIONAL_STATUS = {"open": "pending", "in_progress": "in_progress", "completed": "completed", "cancelled": "cancelled", "deferred": "deferred"}
DEAL_STAGES = ["prospecting", "qualification", "proposal", "negotiation", "closed_won", "closed_lost"]
INTERACTION_TYPES = ["transcript", "note", "document", "email", "meeting"]
CONTENT_FORMATS = ["plain", "markdown", "diarized", "email"]
SOURCE_TYPES = ["web-mic", "upload", "api", "import", "email-pipeline", "gmail", "outlook", "generic", "zoom"]
OWNER_TYPES = ["named", "role_inferred", "unconfirmed"]
MERGE_ROUTES = ["merge", "update_status", "create_new", "link_related"]
MEDDIC = ["metrics", "economic_buyer", "decision_criteria", "decision_process", "identified_pain", "champion"]
# The ontology's dimensions.
DIMENSIONS = [
    "champion_strength",
    "economic_buyer_access",
    "identified_pain",
    "metrics_business_case",
    "decision_criteria_alignment",
    "decision_process_clarity",
    "competitive_position",
    "incumbent_displacement_risk",
    "pricing_alignment",
    "procurement_legal_progress",
    "responsiveness",
    "close_date_credibility",
    "technical_fit",
    "integration_security_risk",
    "change_readiness",
]

# Thresholds.
ITEM_CANDIDATE, ITEM_AUTO = 0.68, 0.88
TOPIC_CANDIDATE, TOPIC_CREATE, TOPIC_LINK = 0.65, 0.70, 0.85
DEAL_CANDIDATE, DEAL_AUTO = 0.70, 0.90
CLUSTER_LINK, VERDICT_FLOOR = 0.80, 0.40
NAME_FUZZY, CONTACT_FUZZY, ROLE_CONFIDENCE = 0.80, 0.75, 0.80


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


CONTACT = "array<struct<contact_id:string,email:string,name:string,role:string>>"
ENVELOPE = (
    "schema_version string, tenant_id string, user_id string, pg_user_id string, interaction_type string, "
    "content struct<text:string,format:string>, timestamp timestamp, source string, interaction_id string, trace_id string, account_id string, "
    f"extras struct<opportunity_id:string,contact_ids:array<string>,contacts:{CONTACT},meeting_title:string,duration_seconds:int,user_name:string,account_name:string,trace_id:string,envelope_id:string>"
)
RECORD = f"version string, id string, `detail-type` string, source string, detail struct<{', '.join(f'`{p.split(chr(32), 1)[0]}`:{p.split(chr(32), 1)[1]}' for p in ENVELOPE.split(', '))}>"
TRANSCRIPTS = (
    "tenant_id string, account_id string, account_name string, transcripts array<struct<sequence:int,meeting_title:string,timestamp:timestamp,"
    "participants:array<string>,text:string,expected_action_items:int,expected_updates:int,notes:string>>"
)

DEAL_FIELDS = "stage string, amount double, opportunity_summary string, " + ", ".join(f"meddic_{m} string" for m in MEDDIC) + ", meddic_completeness double, " + ", ".join(f"dim_{d} int, dim_{d}_confidence double" for d in DIMENSIONS)
CONFIDENCES = ", ".join(f"meddic_{m}_confidence double" for m in MEDDIC)
TABLES = {
    "account": "tenant_id string, account_id string, name string, created_at timestamp",
    "interaction": "tenant_id string, interaction_id string, account_id string, interaction_type string, title string, content_text string, timestamp timestamp, source string, trace_id string, action_item_count long, deal_count long, processed_at timestamp",
    "owner": "tenant_id string, owner_id string, canonical_name string, aliases array<string>, contact_id string, created_at timestamp",
    "action_item": "tenant_id string, action_item_id string, account_id string, summary string, action_item_text string, owner string, status string, priority_score double, confidence double, version long, embedding array<float>, embedding_current array<float>, created_at timestamp, last_updated_at timestamp",
    "action_item_version": "tenant_id string, version_id string, action_item_id string, version long, summary string, status string, valid_from timestamp, valid_until timestamp",
    "topic": "tenant_id string, topic_id string, account_id string, name string, canonical_name string, summary string, action_item_count long, version long, embedding array<float>, embedding_current array<float>, created_from_action_item_id string, created_at timestamp, updated_at timestamp",
    "topic_version": "tenant_id string, version_id string, topic_id string, version_number long, name string, summary string, embedding_snapshot array<float>, changed_by_action_item_id string, created_at timestamp",
    "deal": f"tenant_id string, opportunity_id string, deal_ref string, account_id string, name string, {DEAL_FIELDS}, currency string, evolution_summary string, {CONFIDENCES}, ontology_completeness double, confidence double, source_interaction_id string, version long, embedding array<float>, created_at timestamp, last_updated_at timestamp",
    "deal_version": f"tenant_id string, version_id string, opportunity_id string, version long, name string, {DEAL_FIELDS}, ontology_completeness double, change_source_interaction_id string, valid_from timestamp, valid_until timestamp",
    "contact": "tenant_id string, contact_id string, name string, email string",
}
EDGES = ["has_interaction", "has_action_item", "has_topic", "extracted_from", "owned_by", "has_version", "related_to", "belongs_to", "identifies_as", "engaged_on"]
EDGE = "tenant_id string, src_id string, dst_id string, created_at timestamp, props map<string,string>"
