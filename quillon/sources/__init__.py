"""Where catalogues come from and where they are kept."""
