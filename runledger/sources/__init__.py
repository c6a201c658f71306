"""Readers and writers for the files the automation leaves behind."""
