"""Document-processing operators: DataFrame in, DataFrame out."""
