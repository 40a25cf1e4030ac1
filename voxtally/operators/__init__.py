"""DataFrame-to-DataFrame operators over the comment tables."""
