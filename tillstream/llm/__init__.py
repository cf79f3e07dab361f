"""Training-data operators: one module per operator, `queries.py` registers them."""
