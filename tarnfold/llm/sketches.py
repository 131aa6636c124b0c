"""The bitmaps of ``operators.sketches``, under the name that the training-data operators use."""

from tarnfold.operators.sketches import BITS, SHIFTS, bitmap, maybe

__all__ = ["BITS", "SHIFTS", "bitmap", "maybe"]
