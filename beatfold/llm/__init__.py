"""Training-data operators over document, page and embedding tables. Nothing else in the library imports this."""
