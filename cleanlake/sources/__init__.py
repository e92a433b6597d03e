"""Where the data comes from: named tables and the listing of stored files."""
