"""Column contracts of stored tables."""

# transaction extract: column -> type
TXN_COLUMNS = {
    "id": "long", "version": "long", "transaction_id": "string", "amount": "double", "currency": "string", "transaction_type": "string",
    "status": "string", "branch_id": "long", "origin_account_no": "string", "destination_account_no": "string",
    "customer_name": "string", "customer_email": "string", "identifier": "string", "bvn": "string", "account_type": "string",
    "customer_ip_address": "string", "customer_location": "string", "merchant_name": "string", "origin_country": "string",
    "destination_country": "string", "sender_blacklisted": "boolean", "is_blocked": "boolean", "date_created": "timestamp",
}

INFERENCE_LOG = (
    "event string, ts timestamp, transaction_id string, customer_ref string, status string, activity_code string, "
    "risk_score double, confidence_score double, inference_ms double, triggered_signals array<string>, is_cold_start boolean, "
    "model_version string, geo struct<geo_source:string, geo_eligible:boolean, geo_granularity:string, geo_precision_m:double, "
    "plus_code_present:boolean, plus_code_decoded:boolean, loc_present:boolean, loc_resolved:boolean, ip_present:boolean, "
    "ip_public:boolean, unresolved_reason:string, geo_velocity_available:int, geo_velocity_kmh:double>, day date"
)

DECISION = (
    "transaction_id string, entity_key string, decision string, fired_rules array<string>, amount double, currency string, "
    "latency_ms double, scored_at timestamp"
)
