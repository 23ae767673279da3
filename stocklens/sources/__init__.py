"""Readers and writers: workbooks, typed tables and the inventory sink."""
