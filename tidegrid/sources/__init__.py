"""Readers and writers for bars and news."""
