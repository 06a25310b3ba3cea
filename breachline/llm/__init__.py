"""Training-data preparation operators (independent of the rest of the library)."""
