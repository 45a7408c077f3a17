"""Tables, workbooks and file listings as DataFrames."""
