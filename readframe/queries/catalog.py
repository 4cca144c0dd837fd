"""All queries; importing a module registers what it defines."""

from readframe.queries import alignments, calls, details, evaluation, genomes, labels, sequences, texts  # noqa: F401
from readframe.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
