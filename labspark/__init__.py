"""Laboratory-style analytics and text-corpus operators on PySpark."""
