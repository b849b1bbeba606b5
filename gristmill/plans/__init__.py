"""The four operations users call: clean, gather, profile, analyze."""
