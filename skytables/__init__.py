"""Sky-source catalogs, fixed and moving, as Spark DataFrames."""
