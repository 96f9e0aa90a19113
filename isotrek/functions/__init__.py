"""See README for what lives in isotrek.functions."""
