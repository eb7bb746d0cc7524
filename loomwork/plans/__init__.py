"""Physical-plan helpers: shared storage, lineage cuts, size-checked and skew-safe joins."""
