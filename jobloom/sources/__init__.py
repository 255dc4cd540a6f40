"""Readers and writers for pages, jobs and vectors."""
