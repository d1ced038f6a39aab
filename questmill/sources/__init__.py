"""Readers and writers of question banks, manifests and asset listings."""
