"""Operators of a training-data pipeline (see README, "Training-data operators")."""
