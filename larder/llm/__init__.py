"""Training-data operators: ten operators over raw pages and documents and the
corpus pipeline built from them. Nothing else in the library imports this package."""
