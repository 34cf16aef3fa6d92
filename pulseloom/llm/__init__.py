"""Training-data pipeline operators (deduplication, filtering, search, archives, mixing)."""
