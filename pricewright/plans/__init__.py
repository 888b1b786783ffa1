"""Read queries: offers, families, canonical products and reference lists."""
