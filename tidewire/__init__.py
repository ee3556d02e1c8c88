"""PySpark-native analytics for news-driven market analysis and text corpora."""
