"""Maintainer spells from a stream of observations (an extension; the batch operator is `temporal.spells`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kairograph.functions.intervals import OPEN

OUT = "package string, handle string, vf long, vt long, observed long"
STATE = "runs map<string,struct<vf:long,observed:long>>, last long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs, last = ({h: tuple(r) for h, r in state.get[0].items()}, state.get[1]) if state.exists else ({}, -1)
    seen = pd.concat(list(frames))
    out = []
    for at, group in seen[seen["ob"] > last].groupby("ob", sort=True):
        present = {h for hs in group["handles"] for h in hs}
        for handle in [h for h in runs if h not in present]:
            vf, n = runs.pop(handle)
            out.append((key[0], handle, vf, int(at), n))
        for handle in sorted(present):
            vf, n = runs.get(handle, (int(at), 0))
            runs[handle] = (vf, n + 1)
            out.append((key[0], handle, vf, OPEN, n + 1))
        last = int(at)
    state.update((runs, last))
    yield pd.DataFrame(out, columns=["package", "handle", "vf", "vt", "observed"])


def spells(observations: DataFrame) -> DataFrame:
    """Updates of spells: (package, handle, vf) identifies one, the latest row of it holds. observations: (package, ob, handles),
    in order of ob within each package; late ones are passed over."""
    return observations.groupBy("package").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
