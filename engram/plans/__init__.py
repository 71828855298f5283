"""Composite searches and the chat-to-memory flow."""
