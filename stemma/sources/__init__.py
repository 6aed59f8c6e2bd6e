"""Readers: warehouse catalog, SQL files, job definition files, snapshots."""
