"""Operations of a training-data pipeline over whole corpora. Nothing else in the package imports this."""
