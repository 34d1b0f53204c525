"""Readers and writers of CSV, JSONL and reports."""
