"""Readers, ingest of catalogs and ephemerides, and the Parquet snapshot."""
