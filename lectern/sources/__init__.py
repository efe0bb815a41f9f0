"""Where pages come from and where chunks are kept."""
