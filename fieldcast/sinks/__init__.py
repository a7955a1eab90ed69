"""Table maintenance: upsert, append-if-absent, retention, export."""
