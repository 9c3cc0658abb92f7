"""Readers and writers: driver tables, JSON event files, the stored log and projection."""
