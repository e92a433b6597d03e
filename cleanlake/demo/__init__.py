"""The library's tables derived from a sales and documents data set, to try queries on."""
