"""All registered queries outside the corpus subpackage."""

from foliograph.plans import catalogue, catalogue_files, catalogue_graph, catalogue_more, catalogue_text  # noqa: F401  (each registers its queries)
from foliograph.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
