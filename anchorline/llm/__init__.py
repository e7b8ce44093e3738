"""Training-data operators: one module each, plus ``queries`` that registers them."""
