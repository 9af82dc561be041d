"""Compositions: the end-to-end workflow and the registered query plans."""
