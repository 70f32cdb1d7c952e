"""Relational operators of the reference's dplyr/tidyr vocabulary, on DataFrames."""
