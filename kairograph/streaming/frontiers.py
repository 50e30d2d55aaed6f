"""Search results as they arise: one event for each layer of a search, then a summary."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from kairograph.operators.reach import DEPTH, frontiers


def events(edges: DataFrame, sources: DataFrame, depth: int = DEPTH) -> Iterator[str]:
    """Server-sent-event frames. Rows of a layer are fetched partition by partition, never whole. A search that fails ends with an error
    frame instead of the summary; what was found before has been sent."""
    total = 0
    try:
        for layer, front in enumerate(frontiers(edges, sources, depth=depth)):
            for row in front.toLocalIterator():
                total += 1
                yield f"event: frontier\ndata: {json.dumps({'layer': layer} | row.asDict())}\n\n"
    except Exception as error:  # whatever it is, the reader of the frames has to be told
        yield f"event: error\ndata: {json.dumps({'error': str(error)})}\n\n"
        return
    yield f"event: done\ndata: {json.dumps({'rows': total})}\n\n"
