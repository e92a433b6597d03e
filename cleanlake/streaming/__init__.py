"""The storage scan fed by a stream of newly stored files."""
