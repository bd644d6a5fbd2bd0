"""Readers and writers of outcome shards, task files, reports and run logs."""
