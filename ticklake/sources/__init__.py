"""Readers and writers of frame archives, market tables and their catalogue."""
