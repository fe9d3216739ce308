"""Configuration, errors and access-path choice."""
