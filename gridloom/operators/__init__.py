"""Operations on DataFrames: the view pipeline, tiles, search and profiles."""
