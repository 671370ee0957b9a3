"""tallyloom: storefront behaviour analytics as Spark jobs (DataFrames in, DataFrame out)."""
