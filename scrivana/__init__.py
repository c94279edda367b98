"""scrivana: document processing, provenance and rule evaluation on PySpark DataFrames."""
