"""Planning helpers: shared storage, size-checked broadcasts, deduplication."""
