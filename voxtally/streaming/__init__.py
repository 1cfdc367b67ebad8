"""Row-level steps on a stream of responses."""
