"""Column types shared by the operators."""

from __future__ import annotations

SALARY = "struct<min:double,max:double,raw:string>"
DETECTION = "struct<adapter_id:string,adapter_label:string,method:string,confidence:string>"
POSTING = (
    "struct<title:string,company:string,location:string,"
    f"salary:{SALARY},description_text:string,source_url:string,"
    f"container_tier:string,detection:{DETECTION}>"
)

PAGES = "page_id bigint, url string, html string"
STORED_PAGES = f"{PAGES}, host string"
CAPTURES = (
    "capture_id bigint, tab_id string, captured_at timestamp, url string, html string, "
    "skeleton_removed boolean"
)
REMOTE_COPIES = (
    "fetch_id bigint, remote_url string, adapter_id string, ok boolean, html string, "
    "fetched_at timestamp"
)
APPLICATIONS = (
    "id string, company string, role string, stage string, date_applied timestamp, source_url string"
)
HEALTH = (
    "adapter_id string, adapter_label string, host string, status string, "
    "method string, last_seen timestamp, sample_title string, row bigint"
)
SIGNALS = "signal string, at timestamp"
API_RESPONSES = "endpoint string, status int, body string"
STAGED = "pending_token string, job_posting_text string, source_url string"
CONFIRMS = "pending_token string, date_applied timestamp"

# The sentinels and bars every tier shares.
UNKNOWN_TITLE = "Unknown title"
UNKNOWN_COMPANY = "Unknown company"
MIN_DESCRIPTION = 100
MIN_STRUCTURAL = 600
DOMINANT_SHARE = 0.85
