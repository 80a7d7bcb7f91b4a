"""Readers and writers of the lake's zones, artifacts and documents."""
