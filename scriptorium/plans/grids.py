"""Queries over tables of cells, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import tables
from scriptorium.plans.queries import query
from scriptorium.sources import columns


@query("vertical_merges", """
        WITH RECURSIVE c AS (
            SELECT l_partkey, (n - 1) // 3 AS row, (n - 1) % 3 AS place, n, 1 + CAST(floor(l_quantity) AS BIGINT) % 2 AS colspan, CASE WHEN CAST(floor(l_extendedprice) AS BIGINT) % 3 = 0 THEN 1 + CAST(floor(l_extendedprice) AS BIGINT) % 4 ELSE 1 END AS rowspan
            FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS n FROM lineitem)
        ), w AS (
            SELECT DISTINCT l_partkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS row, CAST(NULL AS BIGINT) AS place, CAST(0 AS BIGINT) AS col, CAST(0 AS BIGINT) AS width, '' AS merge,
                   CAST([] AS STRUCT(col BIGINT, remaining BIGINT, width BIGINT)[]) AS pending FROM c
            UNION ALL
            SELECT l_partkey, n, row, place, col, CASE WHEN len(hit) > 0 THEN hit[1].width ELSE colspan END, CASE WHEN len(hit) > 0 THEN 'continue' WHEN rowspan > 1 THEN 'start' ELSE 'none' END,
                   CASE WHEN len(hit) > 0 THEN list_append(others, {'col': col, 'remaining': hit[1].remaining - 1, 'width': hit[1].width})
                        WHEN rowspan > 1 THEN list_append(others, {'col': col, 'remaining': rowspan - 1, 'width': colspan}) ELSE pending END
            FROM (
                SELECT x.*, list_filter(pending, lambda p: p.col = x.col AND p.remaining > 0) AS hit, list_filter(pending, lambda p: p.col <> x.col) AS others
                FROM (SELECT c.*, w.pending, CASE WHEN c.place = 0 THEN 0 ELSE w.col + w.width END AS col FROM w JOIN c ON c.l_partkey = w.l_partkey AND c.n = w.n + 1) x
            )
        )
        SELECT l_partkey, row, place, col, width, merge FROM w WHERE n > 0""", "lineitem")  # fmt: skip
def _(lineitem):
    """A table of three cells a row for each part, whose line items say how many columns and rows a cell takes."""
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).cast("long") - 1
    price = F.floor("l_extendedprice")
    rowspan = F.when(price % 3 == 0, 1 + price % 4).otherwise(1)
    cells = lineitem.select("l_partkey", n.alias("n"), (1 + F.floor("l_quantity") % 2).alias("colspan"), rowspan.alias("rowspan"))
    cells = cells.select("l_partkey", F.floor(F.col("n") / 3).alias("row"), (F.col("n") % 3).alias("place"), "colspan", "rowspan")
    return tables.vertical_merges(cells, "l_partkey", "row", "place", "colspan", "rowspan").select("l_partkey", "row", "place", "col", "width", "merge")


_SPEC = r"'|@{l\hspace{1cm}}*{' || p_size % 4 || '}{l|p{' || p_size || 'mm}}' || CASE WHEN p_partkey % 2 = 0 THEN 'S[table-format=2.2]' ELSE '' END || '>{\raggedleft}' || p_type || '*{2}{*{' || p_partkey % 3 || '}{c}X}'"


@query("column_specs", r"""
        WITH c AS (
            SELECT p_partkey, [1, k, n] AS place, CASE n WHEN 1 THEN 'l' ELSE 'p' END AS type, 'left' AS alignment, CASE n WHEN 2 THEN CAST(round(p_size * 36000.0) AS BIGINT) END AS width FROM part, range(1, 4) AS r(k), range(1, 3) AS s(n) WHERE k <= p_size % 4
            UNION ALL SELECT p_partkey, [2, 0, 0], 'S', 'center', NULL FROM part WHERE p_partkey % 2 = 0
            UNION ALL SELECT p_partkey, [3, i, 0], ch, CASE WHEN i = first THEN 'right' WHEN ch = 'r' OR ch = 'R' THEN 'right' WHEN ch IN ('c', 'C', 'S', 'D') THEN 'center' ELSE 'left' END, NULL
            FROM (SELECT *, min(i) OVER (PARTITION BY p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(p_type, '')) AS ch, generate_subscripts(string_split(p_type, ''), 1) AS i FROM part) WHERE ch IN ('l', 'c', 'r', 'X', 'L', 'C', 'R', 'J', 'S'))
            UNION ALL SELECT p_partkey, [4, k, n], CASE WHEN n > p_partkey % 3 THEN 'X' ELSE 'c' END, CASE WHEN n > p_partkey % 3 THEN 'left' ELSE 'center' END, NULL FROM part, range(1, 3) AS r(k), range(1, 4) AS s(n) WHERE n <= p_partkey % 3 + 1
        )
        SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS INTEGER) AS number, type, alignment, width FROM c""", "part")  # fmt: skip
def _(part):
    """Specifications in which parts repeat by the size and number of a part, and whose middle is its type."""
    specs = part.select(F.col("p_partkey").alias("path"), F.expr(_SPEC.replace("\\", "\\\\")).alias("source"))
    return columns.columns(specs).withColumnRenamed("path", "p_partkey")
