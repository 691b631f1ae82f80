"""Explicit schemas of the stored records; sources never infer them."""

from __future__ import annotations

MEMBERSHIP = "struct<source_id:string,column_id:string,list_url:string,list_date:string,list_date_raw:string,list_title:string>"
ATTACHMENT = (
    "struct<name:string,url:string,final_url:string,format:string,declared_format:string,detected_format:string,kind:string,size_bytes:bigint,sha256:string,status:string,"
    "needs_manual_review:boolean,text:string,error:string,content_type:string,page_count:int,parser:string>"
)
VERSION = "struct<changed_at:string,old_content_hash:string,old_attachments_hash:string,change_type:string>"
ISSUE = "struct<stage:string,url:string,reason:string>"
EVIDENCE = "struct<label:string,selector:string,meta:string,json_field:string,value:string>"

DOCUMENTS = f"""
    id string, url string, final_url string, schema_version int, title string, doc_number string, issuer string, source_id string, column_id string,
    source_ids array<string>, column_ids array<string>, columns array<{MEMBERSHIP}>, list_date string, publish_date string, written_date string,
    date_metadata map<string,string>, field_evidence map<string,{EVIDENCE}>, content_text string, content_status string, body_selector string,
    attachments array<{ATTACHMENT}>, attachment_metadata_urls array<string>, content_hash string, attachments_hash string, first_seen_at string,
    last_checked_at string, versions array<{VERSION}>, last_fetch_error string, collection_issues array<{ISSUE}>
"""
INTERPRETATION = "struct<summary:string,key_points:array<string>,topics:array<string>,targets:array<string>,impact:struct<direction:string,reason:string>,evidence:array<string>>"
ANALYSES = f"""
    id string, title string, url string, input_hash string, model string, rule_version string, disclaimer string, status string, relevance string,
    relevance_reason string, interpretation {INTERPRETATION}, review_status string, review_reasons array<string>, analyzed_at string, error string
"""
GROUPS = "canonical_id string, member_ids array<string>, source_links array<struct<id:string,url:string,column_ids:array<string>>>"
ANALYSIS_INDEX = "id string, canonical_id string, keywords array<string>, relevance string, status string, visible boolean"
LIST_ENTRY = "url string, title string, list_date string, list_date_raw string"
DAILY_CLOSE = "date string, close double"
COLUMN_HEALTH = f"column_id string, name string, last_run_id string, last_attempt_at string, last_success_at string, consecutive_failures int, last_errors array<{ISSUE}>, status string"
LEDGER = "at string, policy_id string, stage string, reserved_cny decimal(12,4), status string"
REQUEST_LOG = "time string, kind string, url string, method string, status int, attempt int, seconds double, size_bytes bigint, sha256 string, rules string, error string"
