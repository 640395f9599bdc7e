"""Readers and writers: vault folders, tables, canvases, bookmarks."""
