"""chainaug: chain-augmentation data work (merge, folds, prompts, sequences, scoring,
model selection) expressed as Spark DataFrame plans."""

__all__ = ["session"]
