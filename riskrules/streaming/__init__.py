"""Applying a mined ruleset to a stream of transactions.

The method itself is batch-only (no windows, watermarks or state).  What
a stream needs is the finished ruleset applied to new events: the batch
matcher (``operators.ruleset.hits``) is a stream-static existence join, so it
runs unchanged on a streaming DataFrame; this module only adds the amount
bucket and a sink with its checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.joins import checkpoint_dir
from ..operators.bands import with_amount_bucket
from ..operators.model import confident, score_by_tree
from ..operators.ruleset import hits
from ..roles import Params, Roles


def flag_events(events: DataFrame, selected: DataFrame, features: Sequence[str], roles: Roles, params: Params) -> DataFrame:
    """Events (batch or streaming) hit by at least one selected rule, once each.

    ``selected`` is a static DataFrame of at most ``max_rules`` rules; persist
    it before starting a stream.
    """
    return hits(with_amount_bucket(events, roles, params), selected, features, roles, params)


def score_events(events: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Events (batch or streaming) that a tree flags with high confidence.

    ``nodes`` is the table of ``operators.model.tree_nodes``; ``events`` hold the
    tree's input columns.  One projection and one filter, without state."""
    return score_by_tree(events, nodes).where(confident(params))


def start_flagging(
    events: DataFrame,
    selected: DataFrame,
    features: Sequence[str],
    roles: Roles,
    params: Params,
    *,
    name: str,
    sink_format: str = "parquet",
    path: str | None = None,
    trigger: dict | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start an append-mode query writing flagged events; exactly-once file
    sink with its checkpoint under ``spark.checkpoint.dir/<name>`` unless
    ``checkpoint`` names another shared location."""
    out = flag_events(events, selected, features, roles, params)
    ckpt = checkpoint or os.path.join(checkpoint_dir(events.sparkSession), f"stream-{name}")
    w = out.writeStream.outputMode("append").format(sink_format).option("checkpointLocation", ckpt)
    if sink_format == "memory":
        w = w.queryName(name)
    elif path is not None:
        w = w.option("path", path)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
