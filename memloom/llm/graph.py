"""Connected components in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from memloom.llm.common import Scratch
from memloom.operators import graph


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: longs) but the roots; the table of a round goes with the next."""
    return graph.connected_components(edges, scratch.keep, scratch.drop)
