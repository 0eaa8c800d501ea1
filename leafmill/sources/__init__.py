"""Readers and writers: raw files, archives, HTML, manuscripts and bundles."""
