"""lexispark: full-text search, versioned key-value tables and corpus tools on Spark."""
