"""graphloom: graph-evaluation analytics on PySpark DataFrames."""
