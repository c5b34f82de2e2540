"""Operators on DataFrames of pages, lines, chapters and chunks."""
