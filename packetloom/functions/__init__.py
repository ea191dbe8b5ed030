"""Column functions: hashing, octets, arrays and label text."""
