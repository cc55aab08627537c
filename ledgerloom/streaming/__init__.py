"""Empty on purpose: a catalog is a batch of whole snapshots, and staleness is a
comparison of hashes (:func:`ledgerloom.operators.readmodel.is_stale`)."""
