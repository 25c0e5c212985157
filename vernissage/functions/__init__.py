"""Part of the vernissage package."""
