"""Panel assembly: every block joined on one calendar, in a labelled or a complete row set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidemark.operators import panel


def assemble_panel(
    anchors: DataFrame, blocks: Mapping[str, DataFrame], *, row_set: str = "labelled", entity: str = panel.ENTITY,
    day: str = panel.DAY,
) -> DataFrame:
    """Left join every (entity, day) block onto the calendar.

    ``labelled`` keeps days at risk and adds the labels; ``complete`` is the whole calendar without
    labels. Both come from this one function, so they cannot drift apart. Blocks share the join
    keys, so the calendar is shuffled once for all of them.
    """
    cal = panel.calendar(anchors, day=day)
    if row_set == "labelled":
        cal = panel.labels(panel.risk_set(cal, day=day), day=day)
    elif row_set != "complete":
        raise ValueError("row_set must be 'labelled' or 'complete'")
    for block in blocks.values():
        cal = cal.join(block, [entity, day], "left")
    return cal
