"""Schemas of the tables, in one place."""

DOCUMENTS = "file_uid string, source_version string, mime string, name string, path string, content_md string, status string, error string, created_at timestamp, updated_at timestamp"
CHUNKS = "file_uid string, ordinal int, text string, embedding array<float>"
FILES = "file_uid string, name string, content binary, version string, is_dir boolean"
GRANTS = "tenant string, user string, file_uid string, allowed boolean"
EDGES = "parent string, child string, is_container boolean"
CONVERSATIONS = "id string, user_id string, title string, scope array<struct<uid:string,path:string>>, created_at timestamp, updated_at timestamp"
MESSAGES = "conversation_id string, message_id bigint, role string, content string, citations string"
EVENTS = "event_id string, type string, tenant string, file_uid string, version string, actor string, is_rendition boolean, ts string, principal string, permissions int, role string, member string"
