"""Registered queries; importing the package fills the catalog."""

from tidemark.plans import bear, blocks, catalog, cleaning, families, features, frames, kernels, multiscale, recurrence, research, selection, sizing, stores, universes, validation, words

__all__ = ["bear", "blocks", "catalog", "cleaning", "families", "features", "frames", "kernels", "multiscale", "recurrence", "research", "selection", "sizing", "stores", "universes", "validation", "words"]
