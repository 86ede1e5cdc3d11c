"""DataFrame-to-DataFrame operators keyed by document id."""
