"""Analytics built from the operators."""
