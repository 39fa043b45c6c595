"""Readers and writers for the archive, the logs and the published documents."""
