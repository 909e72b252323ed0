"""Readers for run statistics and captured events."""
