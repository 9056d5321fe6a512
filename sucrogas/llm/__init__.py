"""Operators for training-data preparation: names, entities, packing, mixing and splitting of texts."""
