"""Reading documents in and writing results out."""
