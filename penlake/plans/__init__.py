"""The registered queries; importing the package fills the catalogue."""

from penlake.plans import catalogue, collect, runs, training

__all__ = ["catalogue", "collect", "runs", "training"]
