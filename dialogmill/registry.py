"""Name → query and name → oracle SQL of the conversational-data operators."""

from __future__ import annotations

from .plans import corpus, evaluation, feedback, files, memory, retrieval, streams, training
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "evaluation", "feedback", "files", "memory", "retrieval", "streams", "training"]
