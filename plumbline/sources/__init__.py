"""Readers and writers of panels, signals, membership tables and submissions."""
