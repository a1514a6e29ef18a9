"""Sources: sheet scans, header standardisation, test-data bindings."""
