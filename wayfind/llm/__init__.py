"""Training-data operators over document tables. Nothing else in the library imports this package."""
