"""Readers and writers: image folders, capture metadata, path lists, lookup tables, manifests."""
