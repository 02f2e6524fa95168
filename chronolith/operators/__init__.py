"""DataFrame to DataFrame operators on the canonical schemas."""
