"""Declared schemas of the tables."""

DOCUMENTS = (
    "id string, organization_id string, department_id string, uploaded_by string, title string, file_name string,"
    " mime_type string, file_size int, sha256 string, storage_path string, current_version int, status string,"
    " ocr_used boolean, page_count int, error_message string, is_deleted boolean, deleted_at timestamp,"
    " created_at timestamp, updated_at timestamp"
)
CHUNKS = (
    "chunk_id string, organization_id string, source_type string, source_id string, source_version int,"
    " source_title string, section string, page int, chunk_index int, content string, token_count int,"
    " embedding array<float>"
)
POSTINGS = "organization_id string, term string, chunk_id string, tf long"
QUERIES = "query_id long, organization_id string, text string, embedding array<float>"
USERS = (
    "id string, organization_id string, department_id string, name string, email string, username string, role string,"
    " is_superadmin boolean, is_active boolean, locked_until timestamp, failed_login_attempts int,"
    " last_login timestamp, created_at timestamp"
)
SESSIONS = "id string, user_id string, token_hash string, is_revoked boolean, revoked_at timestamp, expires_at timestamp"
AUDIT_LOGS = (
    "id string, organization_id string, actor_id string, actor_name string, event_code string, resource_type string,"
    " resource_id string, resource_name string, ip_address string, outcome string, severity string, metadata string,"
    " created_at timestamp"
)
ATTEMPTS = "id string, key string, action string, ip_address string, created_at timestamp"
JOBS = (
    "id string, organization_id string, type string, resource_id string, status string, progress int, retry_count int,"
    " max_retries int, error string, created_at timestamp, started_at timestamp, completed_at timestamp"
)
SETTINGS = "key string, value string, category string, updated_at timestamp"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
