"""finfacts: Spark-native analytics over company financial filings."""
