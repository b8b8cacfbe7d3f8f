"""Where captures come from and where curated rows go."""
