"""Review analytics on PySpark: every operator is a lazy DataFrame plan."""
