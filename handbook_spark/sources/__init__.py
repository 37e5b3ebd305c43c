"""Readers of handbook material and writers of module exports."""
