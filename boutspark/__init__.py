"""Feeding-contact recordings on Spark: signals, licks, bouts, summaries, statistics."""

from boutspark.params import Params

__all__ = ["Params"]
