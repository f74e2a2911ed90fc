"""Explicit schemas; nothing is inferred."""

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
PLAYER_EVENT = "event STRING, name STRING, data STRING"
CHAT_RESPONSE = "choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>"
