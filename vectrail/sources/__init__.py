"""Corpora, files and message logs as DataFrames."""
