"""Physical-plan helpers: ordered numbering, hot keys, bounded broadcasts, lineage."""
