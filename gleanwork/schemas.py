"""Schemas of the stored tables."""

DOCS = (
    "profile_id string, path string, directory_path string, file_name string, file_name_lc string, extension string, size_bytes long, "
    "last_write_time timestamp, content_indexed boolean, content string, skip_reason string, name_len long, content_len long"
)
POSTINGS = "profile_id string, field string, term string, path string, tf long, positions array<int>, field_len long"
TERMS = "field string, term string"
MANIFEST = "path string, size_bytes long, last_write_time timestamp, indexed_at timestamp, content_indexed boolean"
EXTRACTED = "path string, extension string, size_bytes long, last_write_time timestamp, content string, content_indexed boolean, skip_reason string"
RESULT = (
    "profile_id string, path string, file_name string, directory_path string, extension string, size_bytes long, last_write_time timestamp, "
    "content_indexed boolean, score double, file_name_highlight string, content_highlight string"
)
ADDED, UPDATED, UNCHANGED, REMOVED, FAILED = "Added", "Updated", "Unchanged", "Removed", "Failed"
NAME, CONTENT = "name", "content"
