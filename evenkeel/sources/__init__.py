"""Readers of recordings, side-car files and tables; writers, upserts and resumable appends."""
