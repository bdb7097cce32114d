"""Views that turn the driver's tables into plans: unit corners, text boxes, points, pixels, edges, lines and edits.

The text runs in Spark and in DuckDB; only array positions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_unit_box": """
select p_brand as block, 'Unit_' || cast(p_partkey as varchar(20)) as unit, p_partkey as uid,
  (p_partkey % 50) * 100 + (p_partkey * 13) % 10 as x0,
  cast(floor(p_partkey / 50) as bigint) * 100 + (p_partkey * 17) % 10 as y0,
  cast(40 + p_size as bigint) as w, 40 + (p_partkey * 7) % 50 as h, (p_size % 5 = 0) as l_shape from part""",
    "fx_unit_corner": """
select block, unit, uid, cast(i as bigint) as corner,
  case when l_shape then case i when 1 then x0 when 2 then x0+w when 3 then x0+w
         when 4 then x0+cast(floor(w/2) as bigint) when 5 then x0+cast(floor(w/2) as bigint) else x0 end
       else case i when 1 then x0 when 2 then x0+w when 3 then x0+w else x0 end end as x,
  case when l_shape then case i when 1 then y0 when 2 then y0 when 3 then y0+cast(floor(h/2) as bigint)
         when 4 then y0+cast(floor(h/2) as bigint) when 5 then y0+h else y0+h end
       else case i when 1 then y0 when 2 then y0 when 3 then y0+h else y0+h end end as y
from fx_unit_box cross join (values (1),(2),(3),(4),(5),(6)) as k(i) where i <= 4 or l_shape""",
    "fx_ocr_corner": """
select o_orderkey as box_id, o_orderpriority as text, cast(i as bigint) as corner,
  case i when 1 then bx when 2 then bx+20 when 3 then bx+20 else bx - case when o_orderkey % 3 = 0 then 80 else 0 end end + 0.5e0 as x,
  case when i <= 2 then bt else bt+8 end + 0.5e0 as y
from (select o_orderkey, o_orderpriority, x0+5+(o_orderkey*11)%60 as bx, y0+5+(o_orderkey*7)%60 as bt
      from orders join fx_unit_box on uid = o_orderkey % (select count(*) from part)) t
cross join (values (1),(2),(3),(4)) as k(i)""",
    "fx_point": """
select vec_id as pid, cast(label as varchar(20)) as block,
  cast(floor(cast(E1 as double) * 1000) as bigint) as x, cast(floor(cast(E2 as double) * 1000) as bigint) as y from embeddings""",
    "fx_pixel": """
select event_id % 100 as x, cast(floor(event_id / 100) as bigint) as y,
  (user_id * 37 + cast(floor(event_id / 4) as bigint)) % 180 as h,
  cast(floor(value * 7) as bigint) % 256 as s, 140 + cast(floor(value * 13) as bigint) % 116 as v from events""",
    # an edge for each customer with orders, to another customer of the same forty, who are a plan
    "fx_edge": """
select cast(floor(c / 40) as bigint) + 1 as plan_id, c as eid, c as u, cast(floor(c / 40) as bigint) * 40 + o % 40 as v, 1 + (c * 7 + o * 11) % 23 as length
from (select cast(o_custkey as bigint) as c, cast(min(o_orderkey) as bigint) as o from orders group by o_custkey) t""",
    # three pieces of a level line for each part, every other one backwards, with gaps of 5 to 34
    "fx_piece": """
select p_partkey % 8 + 1 as plan_id, p_partkey as uid, p_partkey * 4 + k as pl_id, case when (p_partkey + k) % 2 = 0 then 3 - i else i + 1 end as seq,
  k * 120 + i * 60 + case when k > 0 then 5 + p_partkey * 7 % 30 else 0 end + case when k > 1 then 5 + p_partkey * 11 % 30 else 0 end as x, p_partkey * 100 as y
from (select cast(p_partkey as bigint) as p_partkey from part) t cross join (values (0),(1),(2)) as a(k) cross join (values (0),(1),(2)) as b(i)""",
    # frames in frames, from one to three deep, around a block or nothing: the outlines of each part, with the one around it
    "fx_frame": """
select plan_id, uid, level, x0 + 2 * level as x, y0 + 2 * level as y, w - 4 * level as w, 13 - 4 * level as h, case when level < least(deep, 2) or deep = 3 then 1 else 0 end as is_frame
from (select p_partkey % 3 + 1 as plan_id, p_partkey as uid, p_partkey % 4 as deep, cast(floor(p_partkey / 3) as bigint) % 40 * 22 as x0, cast(floor(p_partkey / 120) as bigint) * 18 as y0, 13 + p_size % 6 as w
      from (select cast(p_partkey as bigint) as p_partkey, cast(p_size as bigint) as p_size from part) s) t
cross join (values (0),(1),(2)) as k(level) where level <= deep""",
    "fx_trace": """
select user_id as pl_id, row_number() over (partition by user_id order by ts, event_id) as seq,
  (event_id * 7) % 97 as x, (event_id * 11) % 89 as y from events""",
    "fx_edit": """
select event_id as edit_id, ts, case event_type when 'error' then 'delete' when 'signup' then 'restore' else 'noop' end as op,
  user_id % 200 as uid from events""",
}
_TABLES = ("part", "orders", "embeddings", "events", "customer", "supplier")


def _needs(sql: str) -> list[str]:
    """The views that a text names, with those that they need before them."""
    out = [v for v in VIEWS if v in sql]
    if "fx_unit_box" not in out and any(v in ("fx_unit_corner", "fx_ocr_corner") for v in out):
        out.insert(0, "fx_unit_box")
    return sorted(out, key=list(VIEWS).index)


def oracle(sql: str) -> str:
    """DuckDB SQL: the views as common table expressions before ``sql``, which is more of them, or a select."""
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in _needs(sql)).replace("E1", "embedding[1]").replace("E2", "embedding[2]")
    text = sql.strip()
    return f"with recursive {ctes}{' ' if text.startswith('select') else ', '}{text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame, with ``plan_id`` 1 if it has none of its own."""
    sql = VIEWS[name]
    names = _needs(f"{name} {sql}")
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in names).replace("E1", "embedding[0]").replace("E2", "embedding[1]")
    for t in _TABLES:
        if any(f" {t}" in VIEWS[v] for v in names):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    own = "*" if "plan_id" in sql else "cast(1 as bigint) as plan_id, *"
    return spark.sql(f"with {ctes} select {own} from {name}")
