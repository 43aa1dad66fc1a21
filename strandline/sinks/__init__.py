"""Where results are kept."""
