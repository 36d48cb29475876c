"""Readers and writers of sensor formats."""
