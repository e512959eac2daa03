"""Training-data operators: ten corpus operators, each by one named method. Nothing outside imports this package."""
