"""Cells over several rows against a walk over the rows, and what goes on from round to round."""

import random

from scriptorium.operators import tables


def walk(cells):
    """Column, width and merge of the cells (row, place, colspan, rowspan) of a table, in order."""
    out, pending, row, col = [], {}, None, 0
    for r, p, colspan, rowspan in sorted(cells):
        col = col if r == row else 0
        row = r
        left, width = pending.get(col, (0, 0))
        if left:
            pending[col] = (left - 1, width)
        else:
            width = colspan
            if rowspan > 1:
                pending[col] = (rowspan - 1, width)
        out.append((r, p, col, width, "continue" if left else "start" if rowspan > 1 else "none"))
        col += width
    return out


def test_tables_go_on_only_while_they_change(spark, monkeypatch):
    rng = random.Random(3)
    tall = [(r, p, rng.randrange(1, 4), rng.choice([1, 1, 2, 3])) for r in range(24) for p in range(4)]
    cells = {i: [(r, p, 1 + r % 2 * (p == 0), 1) for r in range(3) for p in range(2)] for i in range(20)} | {90: tall}
    df = spark.createDataFrame([(i, *c) for i, own in cells.items() for c in own], "t long, r long, p long, colspan long, rowspan long")
    sizes, own = [], tables.written

    def written(rows):
        out = own(rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(tables, "written", written)
    got = tables.vertical_merges(df, "t", "r", "p", "colspan", "rowspan").collect()
    for i, own_cells in cells.items():
        assert sorted((x.r, x.p, x.col, x.width, x.merge) for x in got if x.t == i) == walk(own_cells)
    assert len(sizes) > 1 and set(sizes[1:]) == {len(tall)}
    assert tables.vertical_merges(df.limit(0), "t", "r", "p", "colspan", "rowspan").count() == 0
