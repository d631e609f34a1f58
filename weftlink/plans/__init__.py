"""End-to-end workflows and their settings."""
