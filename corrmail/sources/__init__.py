"""Readers and writers, and the adapter from conversations to messages."""
