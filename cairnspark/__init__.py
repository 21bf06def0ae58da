"""cairnspark: search, browse and analytics over text and source-code corpora on PySpark."""
