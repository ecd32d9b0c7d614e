"""Training-data operators on the library's text records, by default analysis documents (area, document)."""
