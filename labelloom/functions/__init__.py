"""Column functions: text, URLs, labels, boxes, hashes."""
