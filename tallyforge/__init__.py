"""tallyforge: usage analytics and data preparation expressed as Spark DataFrame plans."""
