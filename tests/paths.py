"""Folders of the given tables."""

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
