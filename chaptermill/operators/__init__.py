"""DataFrame to DataFrame operators over texts, ranges, revisions and tasks."""
