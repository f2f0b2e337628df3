"""Column functions: text, addresses, hashes, scores. All are native expressions but for NFKC and HTML."""
