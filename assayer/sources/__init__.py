"""Readers, writers and the batch-log table behind the silver layer."""
