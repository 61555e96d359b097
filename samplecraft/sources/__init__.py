"""Scans and sinks: manifests, the metadata table, run logs, histories, heads, images."""
