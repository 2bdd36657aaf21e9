"""Training-data operators over text and web pages.  Nothing else in the library imports this package."""
