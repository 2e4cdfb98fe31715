"""Sessions, lineage, cached steps, the whole plan and the safety lint."""
