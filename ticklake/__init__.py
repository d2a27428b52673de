"""Market tape analytics on Spark: order books, fills, cross-market reports and their streams."""
