"""Continuations over a stream of pages: a folder's open run is kept from trigger to trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilmark.operators.ordered import CONTINUATION, PRIMARY


def continue_stream(pages: DataFrame, folder: str, order: str, time: str, delay: str = "1 day", fields: list[str] = (), kind: str = "kind") -> DataFrame:
    """(folder, order, kind, fields, run_no, attached, page_number) of pages as they come.

    What :func:`veilmark.operators.ordered.continue_runs` gives, for pages that come in
    order: a trigger's pages of a folder are sorted (a trigger's size bounds them), those
    of later triggers continue the run that is open.  State is a few values a folder: the
    run's number, kind, length and the ``fields`` (strings) that continuations take.  A
    folder without pages for ``delay`` (by the watermark on ``time``) is closed and forgotten; a
    page that comes later begins anew.  A null kind neither opens a run nor is attached;
    null folders are one folder.
    """
    fields = list(fields)
    seen = pages.withWatermark(time, delay).select(folder, order, kind, time, *fields, F.unix_millis(time).alias("_at"))
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    held = ", ".join(f"f{i} string" for i in range(len(fields)))
    shown = ", ".join(f"`{c}` {types[c]}" for c in (folder, order, kind, *fields))
    millis = int(pd.Timedelta(delay) / pd.Timedelta(milliseconds=1))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, head, length, *taken = state.get if state.exists else (0, None, 0, *[None] * len(fields))
        rows, latest = [], state.getCurrentWatermarkMs()
        for r in sorted((x for b in batches for x in b[[order, kind, "_at", *fields]].itertuples(index=False, name=None)), key=lambda x: x[0]):
            own = [v if isinstance(v, str) else None for v in r[3:]]
            latest = latest if pd.isna(r[2]) else max(latest, int(r[2]))
            what = r[1] if isinstance(r[1], str) else None
            if what not in (None, CONTINUATION):
                number, head, length, taken = number + 1, what, 0, own
            length += 1
            attached = what == CONTINUATION and head == PRIMARY
            page = length if attached else 1 if what == PRIMARY else None
            filled = [v if v is not None or not attached else t for v, t in zip(own, taken, strict=True)]
            rows.append((key[0] if isinstance(key[0], str) else None, r[0], what, *filled, number, attached, page))
        state.update((number, head, length, *taken))
        state.setTimeoutTimestamp(latest + millis + 1)
        out = pd.DataFrame(rows, columns=[folder, order, kind, *fields, "run_no", "attached", "page_number"])
        yield out.astype({"page_number": "Int32"})

    return seen.groupBy(F.col(folder)).applyInPandasWithState(
        run, f"{shown}, run_no long, attached boolean, page_number int", f"number long, head string, length long{', ' + held if held else ''}",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
