"""Stores, snapshots, files and delimited text."""
