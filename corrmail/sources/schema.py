"""Schemas of messages and the tables around them."""

from __future__ import annotations

MESSAGE = (
    "id long, account_id long, folder_id long, uid long, message_id string, in_reply_to string, `references` array<string>, date string, "
    "subject string, subject_normalized string, from_email string, from_name string, to_text string, cc_text string, reply_to string, "
    "body_text string, body_html_text string, has_attachments boolean, attachment_names string, attachment_types string, "
    "is_sent_by_me boolean, is_auto_reply boolean, is_bounce boolean, is_system_notification boolean, content_hash string"
)
ACCOUNT = "account_id long, email string, server string, port int, use_ssl boolean"
FOLDER = "folder_id long, account_id long, name string, raw_name string, folder_type string, uidvalidity long, uidnext long, last_sync_uid long, message_count long"
SYNC_STATE = "account_id long, folder_id long, uidvalidity long, last_sync_uid long"
OVERRIDE = "email string, field string, value string, created_at timestamp, seq long"
ANALYSIS = "email string, summary string, evidence string, intent string, action string, step string, responder string, confidence double, created_at timestamp, seq long"
ALIAS = "teacher_name string, institution string, email string, alias_email string, notes string"
QUARANTINE = "path string, error string"
