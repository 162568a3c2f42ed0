"""Cells, measures and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.operators import tables
from tracebound.plans.ordered import positions
from tracebound.workload import frames as B
from tracebound.workload import sql as S
from tracebound.workload.registry import query


@query("n03_explode_cells", f"""WITH {S.TYPED}
SELECT source_id, 0 AS row_idx, generate_subscripts(c,1)-1 AS col_idx, unnest(c) AS cell,
  unnest(['lang','line']) AS name FROM (SELECT source_id, [lang, line] AS c FROM typed WHERE has_rows)""")
def _(spark, folder):
    units = B.typed_units(spark, folder).filter(F.col("rows").isNotNull())
    cells, columns = tables.explode_cells(units, "source_id")
    return cells.join(columns, ["source_id", "col_idx"])


@query("a03_recommend_mode", f"""
WITH t AS (SELECT source, sum(len({S.tokens('text','analysis')}))::BIGINT AS numeric_tokens
  FROM documents GROUP BY source)
SELECT *, CASE WHEN numeric_tokens >= 8 THEN 'data-first' ELSE 'evidence-first' END AS mode,
  CASE WHEN numeric_tokens >= 8 THEN 'quantitative-evidence' ELSE 'narrative-evidence' END AS reason
FROM t""")
def _(spark, folder):
    return tables.recommend_mode(
        B.table(spark, folder, "documents").select("source", "text"), "source")


def _cells(spark, folder):
    """Part cells with some measure cells made blank or textual, so choices differ."""
    key = F.regexp_extract("dataset_id", r"(\d+)", 1).cast("int")
    cell = (
        F.when((F.col("col_idx") == 2) & (key % 3 == 0) & (F.col("row_idx") % 2 == 0), "n/a")
        .when((F.col("col_idx") == 1) & (key % 5 == 0), F.col("row_idx").cast("string"))
        .otherwise(F.col("cell")))
    return B.part_cells(spark, folder).withColumn("cell", cell)


_CELLS = f"""raw_cells AS (SELECT p_brand AS dataset_id, row_idx, generate_subscripts(cs,1)-1 AS col_idx,
    unnest(cs) AS cell, regexp_extract(p_brand, '\\d+')::INT AS k
  FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1 AS row_idx,
    [p_partkey::VARCHAR, p_name, p_size||' cm', (p_retailprice::DECIMAL(15,2))::VARCHAR] AS cs
    FROM part)),
cells AS (SELECT dataset_id, row_idx, col_idx, CASE WHEN col_idx=2 AND k%3=0 AND row_idx%2=0 THEN 'n/a'
    WHEN col_idx=1 AND k%5=0 THEN row_idx::VARCHAR ELSE cell END AS cell FROM raw_cells),
tc AS (SELECT *, {S.PARSED_CELL} AS num,
    {S.trim(f"regexp_extract({S.trim('cell')}, '{fixed.NUMERIC_CELL}', 2)")} AS unit FROM cells),
typed_cells AS (SELECT *, {S.trim('cell')} <> '' AND num IS NULL AS is_text FROM tc),
nrows AS (SELECT dataset_id, max(row_idx)+1 AS rows FROM cells GROUP BY 1),
counts AS (SELECT dataset_id, col_idx, count(*) AS n FROM typed_cells
  WHERE col_idx >= 1 AND num IS NOT NULL GROUP BY 1,2),
measure AS (SELECT dataset_id, col_idx AS measure_col, n AS numeric_cells, rows FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, col_idx) AS r FROM counts)
  JOIN nrows USING (dataset_id) WHERE r=1 AND n >= 2 AND rows >= 2),
lab AS (SELECT m.*, coalesce((SELECT max(t.col_idx) FROM (SELECT dataset_id, col_idx, count(*) AS n
      FROM typed_cells WHERE is_text GROUP BY 1,2) t
    WHERE t.dataset_id=m.dataset_id AND t.col_idx < m.measure_col AND t.n >= ceil(m.rows/2.0)), 0)
  AS label_col FROM measure m),
tseries AS (SELECT l.dataset_id, v.row_idx, CASE WHEN p.num IS NOT NULL THEN coalesce(
      (SELECT arg_min(f.cell, f.col_idx) FROM typed_cells f WHERE f.dataset_id=v.dataset_id
        AND f.row_idx=v.row_idx AND f.is_text), (v.row_idx+1)::VARCHAR)
      ELSE coalesce(p.cell, (v.row_idx+1)::VARCHAR) END AS label,
    replace(v.num, ',', '')::DOUBLE AS value, v.unit, {S.trim('v.cell')} AS display
  FROM lab l JOIN typed_cells v ON v.dataset_id=l.dataset_id AND v.col_idx=l.measure_col
    AND v.num IS NOT NULL AND replace(v.num,',','')::DOUBLE >= 0
  LEFT JOIN typed_cells p ON p.dataset_id=v.dataset_id AND p.row_idx=v.row_idx
    AND p.col_idx=l.label_col),
vis AS (SELECT * FROM tseries WHERE dataset_id IN
  (SELECT dataset_id FROM tseries GROUP BY 1 HAVING count(*) >= 2))"""


@query("a04_select_measure", f"""WITH {_CELLS}
SELECT dataset_id, measure_col, numeric_cells, rows FROM measure""")
def _(spark, folder):
    return tables.select_measure(tables.typed_cells(_cells(spark, folder)))


@query("a05_select_label", f"""WITH {_CELLS}
SELECT dataset_id, measure_col, label_col FROM lab""")
def _(spark, folder):
    return tables.select_label(tables.typed_cells(_cells(spark, folder)))


@query("a06_table_series", f"WITH {_CELLS} SELECT * FROM vis")
def _(spark, folder):
    return tables.table_series(_cells(spark, folder))


@query("a07_dominant_unit", f"""WITH {_CELLS},
u AS (SELECT dataset_id, CASE WHEN row_idx%3=1 THEN 'mm' WHEN row_idx%5=2 THEN '' ELSE unit END
    AS unit, row_idx FROM vis),
c AS (SELECT dataset_id, unit, count(*) AS n, min(row_idx) AS first_ FROM u WHERE unit <> '' GROUP BY 1,2),
b AS (SELECT dataset_id, unit FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY n DESC, first_) AS r FROM c) WHERE r=1)
SELECT h.dataset_id, coalesce(b.unit, 'kW') AS unit FROM
  (SELECT DISTINCT dataset_id FROM cells) h LEFT JOIN b USING (dataset_id)""")
def _(spark, folder):
    rows = tables.table_series(_cells(spark, folder)).withColumn(
        "unit", F.when(F.col("row_idx") % 3 == 1, "mm").when(F.col("row_idx") % 5 == 2, "")
        .otherwise(F.col("unit")))
    headers = B.table(spark, folder, "part").select(
        F.col("p_brand").alias("dataset_id"), F.lit("Size (kW)").alias("name")).distinct()
    return tables.dominant_unit(rows, headers)


@query("a08_comparable_groups", """
WITH v AS (SELECT p_brand AS dataset_id, p_partkey AS ord, p_name AS label, p_size::DOUBLE AS value,
    ['cm','年','kg'][(p_partkey%3)::INT+1] AS unit FROM part),
u AS (SELECT dataset_id, unit, value, min(ord) AS ord, arg_max(label, ord) AS label FROM v
  WHERE unit <> '年' AND value >= 0 GROUP BY 1,2,3),
g AS (SELECT dataset_id, unit, count(*) AS n, min(ord) AS first_ FROM u GROUP BY 1,2 HAVING count(*) >= 2),
b AS (SELECT dataset_id, unit FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY n DESC, first_) AS r FROM g) WHERE r=1)
SELECT dataset_id, unit, value, ord, label, position FROM (
  SELECT u.*, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS position
  FROM u JOIN b USING (dataset_id, unit)) WHERE position <= 12""")
def _(spark, folder):
    units = F.array(F.lit("cm"), F.lit("年"), F.lit("kg"))
    values = B.table(spark, folder, "part").select(
        F.col("p_brand").alias("dataset_id"), F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("label"), F.col("p_size").cast("double").alias("value"),
        F.element_at(units, (F.col("p_partkey") % 3 + 1).cast("int")).alias("unit"))
    return tables.comparable_groups(values)


_GAPS = S.SERIES + """,
gaps AS (SELECT dataset_id, x_idx, x, series, CASE WHEN (x_idx + length(series))%7=0 THEN NULL
  WHEN dataset_id='P' AND x_idx%50=0 THEN NULL ELSE value END AS value FROM series)"""


def _gaps(spark, folder):
    gone = ((F.col("x_idx") + F.length("series")) % 7 == 0) | (
        (F.col("dataset_id") == "P") & (F.col("x_idx") % 50 == 0))
    return B.order_series(spark, folder).withColumn(
        "value", F.when(~gone, F.col("value")))


@query("a09_trend_groups", f"""WITH {_GAPS},
p AS (SELECT dataset_id, x_idx, count(value) AS n FROM gaps GROUP BY 1,2),
f AS (SELECT dataset_id FROM p GROUP BY 1 HAVING count(*) >= 2 AND min(n) > 0)
SELECT dataset_id, x_idx, x, series, value FROM gaps JOIN f USING (dataset_id) WHERE value IS NOT NULL""")
def _(spark, folder):
    return tables.trend_groups(_gaps(spark, folder)).select(
        "dataset_id", "x_idx", "x", "series", "value")


@query("a10_scale_bars", f"""WITH {_CELLS},
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_idx)-1 AS pos,
  greatest(max(value) OVER (PARTITION BY dataset_id), 1.0) AS m FROM vis)
SELECT dataset_id, row_idx, round(greatest(2.0, value/m*100), 6) AS width,
  pos%8+1 AS palette_slot, pos >= 8 AS reused FROM n""")
def _(spark, folder):
    return tables.scale_bars(tables.table_series(_cells(spark, folder))).select(
        "dataset_id", "row_idx", F.round("width", 6).alias("width"), "palette_slot", "reused")


@query("a10_axis_ticks", f"""WITH {_CELLS},
m AS (SELECT dataset_id, greatest(max(value), 1.0) AS m FROM vis GROUP BY 1)
SELECT dataset_id, r AS ratio, m*r AS tick FROM m, (VALUES (0.0::DOUBLE),(0.25),(0.5),(0.75),(1.0)) v(r)""")
def _(spark, folder):
    return tables.axis_ticks(tables.table_series(_cells(spark, folder)))


@query("a11_scale_points", """
WITH p AS (SELECT o_orderpriority AS dataset_id, o_orderkey, (o_custkey%97)::DOUBLE AS x,
  o_totalprice AS y FROM orders),
m AS (SELECT *, greatest(max(x) OVER w, 1.0) AS mx, greatest(max(y) OVER w, 1.0) AS my FROM p
  WINDOW w AS (PARTITION BY dataset_id))
SELECT dataset_id, o_orderkey, round(x/mx*100, 6) AS left_pct, round(y/my*100, 6) AS bottom_pct FROM m""")
def _(spark, folder):
    points = B.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"), "o_orderkey",
        (F.col("o_custkey") % 97).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return tables.scale_points(points).select(
        "dataset_id", "o_orderkey", F.round("left_pct", 6).alias("left_pct"),
        F.round("bottom_pct", 6).alias("bottom_pct"))


@query("n04_chart_to_table", f"""WITH {S.SERIES},
p AS (SELECT dataset_id, substr(series,1,1)::INT AS series_idx, x_idx AS idx,
    CASE WHEN (x_idx + substr(series,1,1)::INT)%3=0 THEN x END AS category,
    CASE WHEN x_idx%7 <> substr(series,1,1)::INT THEN value::DECIMAL(38,2)::VARCHAR END AS value
  FROM series),
c AS (SELECT dataset_id, idx, arg_min(category, series_idx) FILTER (category IS NOT NULL) AS category
  FROM p GROUP BY 1,2),
s AS (SELECT DISTINCT dataset_id, series_idx FROM p)
SELECT c.dataset_id, c.idx, coalesce(c.category, (c.idx+1)::VARCHAR) AS category,
  s.series_idx::BIGINT AS series_idx, coalesce(p.value, '') AS value
FROM c JOIN s USING (dataset_id) LEFT JOIN p ON p.dataset_id=c.dataset_id AND p.idx=c.idx
  AND p.series_idx=s.series_idx""")
def _(spark, folder):
    n = F.substring("series", 1, 1).cast("int")
    points = B.order_series(spark, folder).select(
        "dataset_id", n.alias("series_idx"), F.col("x_idx").alias("idx"),
        F.when((F.col("x_idx") + n) % 3 == 0, F.col("x")).alias("category"),
        F.when(F.col("x_idx") % 7 != n, F.col("value").cast("decimal(38,2)").cast("string"))
        .alias("value"))
    return tables.chart_to_table(points).withColumn(
        "series_idx", F.col("series_idx").cast("bigint"))


@query("q06_unvisualised_datasets", f"""WITH {_CELLS}
SELECT DISTINCT dataset_id FROM vis WHERE dataset_id NOT LIKE '%1%'""")
def _(spark, folder):
    charts = B.table(spark, folder, "part").filter(F.col("p_brand").contains("1")).select(
        F.col("p_brand").alias("dataset_id"))
    return tables.unvisualised_datasets(_cells(spark, folder), charts)


@query("o01_top_rows", """
SELECT o_orderpriority, o_orderkey, position FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY o_orderkey) AS position FROM orders) WHERE position <= 12""")
def _(spark, folder):
    orders = B.table(spark, folder, "orders").select("o_orderpriority", "o_orderkey")
    return tables.top_rows(orders, ["o_orderpriority"], "o_orderkey")


@query("w05_order_in_document", """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS ord
FROM conversations""")
def _(spark, folder):
    turns = B.table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return positions(
        turns, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 4096), "ord", start=0)
