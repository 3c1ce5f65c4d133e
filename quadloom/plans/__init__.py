"""Query text to algebra to DataFrame plans, and the catalog of driver queries."""
