"""Text operators for large training corpora: each module is one operator, queries.py names them."""
