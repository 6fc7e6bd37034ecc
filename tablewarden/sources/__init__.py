"""Where evidence comes from."""
