"""Operations of large training-data pipelines, one module each."""
