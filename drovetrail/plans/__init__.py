"""Query registries and their oracle SQL."""
