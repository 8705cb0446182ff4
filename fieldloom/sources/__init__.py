"""Readers, writers and the facts held in file names and scene rows."""
