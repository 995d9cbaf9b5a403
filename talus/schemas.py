"""Schemas of the engine's tables, as DDL strings."""

SAML_RAW = ", ".join(
    f"`{c}` STRING"
    for c in (
        "Time", "Date", "Sender_account", "Receiver_account", "Amount", "Payment_currency", "Received_currency",
        "Sender_bank_location", "Receiver_bank_location", "Payment_type", "Is_laundering", "Laundering_type",
    )
)
TRANSACTIONS = (
    "transaction_id STRING, timestamp TIMESTAMP, amount_brl DECIMAL(18,2), payment_type STRING, sender_account STRING, receiver_account STRING, "
    "sender_location STRING, receiver_location STRING, currency_sent STRING, currency_received STRING, laundering_type STRING, is_laundering INT"
)
CUSTOMERS = "customer_id STRING, name STRING, cpf_cnpj STRING, segment STRING, restriction_flags ARRAY<STRING>"
ACCOUNTS = "account STRING, customer_id STRING"
META = "key STRING, value STRING"
NORM_CHUNKS = "chunk_id STRING, doc_id STRING, article_ref STRING, text STRING, text_sha256 STRING, corpus_version STRING, source_url STRING"
CITATIONS = "alert_id STRING, pos INT, chunk_id STRING, article_ref STRING, quoted_text STRING, applicability STRING"
FEATURES = "alert_id STRING, feature_id STRING, name STRING, value_int LONG, value_str STRING, transaction_ids ARRAY<STRING>"
AUDIT_EVENTS = (
    "seq LONG, event_key STRING, occurred_at STRING, alert_id STRING, event_type STRING, actor STRING, state_from STRING, state_to STRING, model_id STRING, "
    "prompt_sha256 STRING, rules_version INT, corpus_version STRING, mapping_version INT, prompt_version STRING, tokens_in LONG, tokens_out LONG, latency_ms LONG, "
    "prev_hash STRING, hash STRING"
)
MODEL_OUTPUT = "t STRING, c DOUBLE, r STRING, e ARRAY<INT>"
