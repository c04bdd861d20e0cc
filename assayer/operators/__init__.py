"""DataFrame operators: DataFrame in, DataFrame out, for use with df.transform()."""
