"""Connected components of an edge table: every node hooks to its least neighbour and what hooks is contracted, after the first rounds whole
trees by pointer doubling; the rest of the edges goes on between the trees. Rounds and written tables grow with the logarithm of a chain's length.

A node is handled by partial minima and joins, never by collecting its neighbours. Every step's small tables are written to the
shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from evidentia.llm.tables import written
from evidentia.operators.graph import clusters


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges(a, b), root the least node of the component; self loops and repeated edges do no harm. No edges, no rows."""
    return clusters(edges, written).withColumnRenamed("cluster", "root")
