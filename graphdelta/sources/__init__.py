"""Readers and writers: driver tables, edge snapshots, tiles, results."""
