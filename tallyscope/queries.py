"""The registered core queries and their SQL twins."""

from tallyscope.plans import artifacts, checks, composites, documents, governance, logs, markup, objects, observations, packages, requests, responses, reviews, scenes, scoring, selection  # noqa: F401
from tallyscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
