"""Sinks: per-page records, labelled data sets, metadata documents and expiring stores."""
