"""Vision-shaped tables derived from the base tables by integer SQL, the same in Spark and other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("orders", "lineitem", "events", "part")
#: An image is four consecutive orders. Each order is one 4 x 4 tile of its rasters, and one query of its saved outputs.
SIDE, QUERIES = 8, 4
IMAGE, _SLOT = "cast(floor(o_orderkey/4) as bigint)", "(o_orderkey%4)"
_TILE = "cross join (select {r} as dx from range(4)) t cross join (select {r} as dy from range(4)) u"
#: A document of so many images, as an expression of orders.
DOCUMENT = f"floor({IMAGE}/100)"
_GRID = "cross join (select {r} as x from range(8)) t cross join (select {r} as y from range(8)) u"
_TILED = f"(select o.*, {IMAGE} as image_id, ({_SLOT}%2)*4+dx as x, cast(floor({_SLOT}/2) as bigint)*4+dy as y, dx, ({_SLOT}*3+o_custkey)%10 as k from orders o {_TILE}) z"
#: A mask is a box of half the size; every third one has a hole, its middle third; others one that is empty.
_HOLED = """select image_id, category_id, {key}, {more}, x0, y0, x1, y1, 200+image_id%100 as height, 250+image_id%150 as width,
 case when {key}%3=0 then x0+cast(floor((x1-x0)/3) as bigint) else 100000 end as hx0, case when {key}%3=0 then y0+cast(floor((y1-y0)/3) as bigint) else 100000 end as hy0,
 case when {key}%3=0 then x0+2*cast(floor((x1-x0)/3) as bigint) else -100000 end as hx1, case when {key}%3=0 then y0+2*cast(floor((y1-y0)/3) as bigint) else -100000 end as hy1 from ({part}) z"""

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "gt_box": (("lineitem",), """select l_orderkey as image_id, ((l_partkey*10000+l_suppkey)*10+l_linenumber)*100+cast(l_quantity as bigint) as ann_id, l_suppkey%5 as category_id,
 cast(l_partkey%400 as double) as x0, cast((l_partkey*7)%300 as double) as y0,
 cast(l_partkey%400 as double)+20+l_quantity as x1, cast((l_partkey*7)%300 as double)+20+(l_suppkey%60) as y1,
 case when l_returnflag='R' and l_linenumber=7 then 1 else 0 end as iscrowd, 1-l_discount*5 as visibility_fraction from lineitem"""),
    "det_box": (("gt_box",), """select image_id, ann_id as det_id, case when p%13=0 then (s+1)%5 else s%5 end as category_id,
 x0+s%7-3 as x0, y0+s%5-2 as y0, x1+s%11-5 as x1, y1+s%9-4 as y1, cast((p*31+s*17+ln*7)%1000 as double)/1000 as score
from (select g.*, cast(floor(ann_id/10000000) as bigint) as p, cast(floor(ann_id/1000) as bigint)%10000 as s, cast(floor(ann_id/100) as bigint)%10 as ln from gt_box g) t where p%10<8"""),
    "px": (("orders",), f"""select image_id, y, x,
 case when (x*3+y*5+o_orderkey)%23=0 or (k=9 and image_id%3=0) then 255 else k end as gt,
 case when x=7 and y=7 then 10 when (x*5+y*3+o_custkey)%(2+image_id%9)=0 then (k+1)%10 else k end as pred from {_TILED}"""),
    "query_cls": (("orders",), f"""select {IMAGE} as image_id, {_SLOT} as q, c, cast(((o_orderkey*13+c*53+o_custkey)%41)-36 as double)/4 as logit
from orders cross join (select {{r}} as c from range(6)) b"""),
    "query_mask": (("orders",), f"""select {IMAGE} as image_id, {_SLOT} as q, y, x,
 cast((2+o_orderkey%3)*2-2*greatest(abs(x-(o_custkey*7)%8),abs(y-(o_custkey*5)%8))+1 as double)/2 as logit from orders {_GRID}"""),
    "categories": (("part",), "select pos, pos*3+1 as id, concat('cat_',cast(pos as string)) as name, case when pos<5 then 1 else 0 end as isthing from (select distinct p_partkey%11 as pos from part) r"),
    "id_map": (("part",), "select ins_id, ins_id-1 as sem_id from (select distinct p_partkey%5+1 as ins_id from part) r"),
    "parts_px": (("orders",), f"""select image_id, y, x, case when (x+y)%29=0 then 0 else k+1 end as sem_raw,
 case when k<5 then k+1 else 0 end as inst_cat_raw, case when k<5 and dx<3 then 1+{_SLOT} else 0 end as inst_id from {_TILED}"""),
    "query_box": (("orders",), f"""select {IMAGE} as image_id, {_SLOT} as q, cast((o_custkey*7)%8 as double)/8 as cx, cast((o_custkey*5)%8 as double)/8 as cy,
 cast((2+o_orderkey%3)*2 as double)/8 as w, cast((2+o_orderkey%3)*2 as double)/8 as h from orders"""),
    "gt_mask": (("gt_box",), _HOLED.format(key="gt_id", more="iscrowd", part="select image_id, category_id, ann_id as gt_id, iscrowd, cast(floor(x0/2) as bigint) as x0, cast(floor(y0/2) as bigint) as y0, cast(floor(x1/2) as bigint) as x1, cast(floor(y1/2) as bigint) as y1 from gt_box")),
    "det_mask": (("det_box",), _HOLED.format(key="det_id", more="score", part="select image_id, category_id, det_id, score, cast(floor(greatest(x0,0.0)/2) as bigint) as x0, cast(floor(greatest(y0,0.0)/2) as bigint) as y0, cast(floor(x1/2) as bigint) as x1, cast(floor(y1/2) as bigint) as y1 from det_box")),
    "frames": (("events",), """select user_id as stream_id, cast(row_number() over (partition by user_id order by event_id)-1 as bigint) as frame_idx, event_id, ts, value as latency_ms, props as annotations_json from events"""),
}


#: Orders of a task, each of which becomes 64 pixels at most; lines of a task where each becomes a mask.
ORDERS, LINES = 16_384, 32_768


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df by an expression into so many parts that each has some `rows`: what a part becomes does not grow with the table."""
    return df.repartition(max(2, -(-df.count() // rows)), F.expr(key))


def frame(spark: SparkSession, sf_dir: str, name: str, by: str = IMAGE) -> DataFrame:
    """A base table or a fixture.

    Fixtures of orders are dealt by image before they become pixels, so groups within an image need no shuffle of them;
    or `by` what holds whole images."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = SQL[name]
    for n in needs:
        df = frame(spark, sf_dir, n, by)
        (dealt(df, by, ORDERS) if n == "orders" else df).createOrReplaceTempView(n)
    return spark.sql(text.replace("{r}", "id"))


def ctes(*names: str) -> list[str]:
    """Common table expressions of fixtures and of what they need, for engines that have only the base tables."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in SQL and name not in out:
            for n in SQL[name][0]:
                add(n)
            out[name] = f"{name} as ({SQL[name][1].replace('{r}', 'range')})"

    for n in names:
        add(n)
    return list(out.values())


def oracle(names: tuple[str, ...], body: str, *more: str) -> str:
    """SQL over base tables: fixtures, then further named steps `name as (...)`, then the body."""
    parts = [*ctes(*names), *more]
    return (f"with {', '.join(parts)} " if parts else "") + body
