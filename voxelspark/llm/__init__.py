"""Training-data operators on tables of documents. Nothing else in the library imports this subpackage."""
