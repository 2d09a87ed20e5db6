"""molframe: tables about many macromolecular structures at once, as Spark DataFrames."""
