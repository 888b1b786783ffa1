"""Building blocks: filters, latest-row collapse, ordering and pages, product matching, writes."""
