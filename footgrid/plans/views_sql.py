"""SQL forms of the input views, for the comparison queries."""

FRAME = """im as (select distinct s_suppkey // 25 as image from supplier),
fr as (select image, rr.r::int as r, cc.c::int as c from im,
       (select unnest(range(0, 128)) as r) rr, (select unnest(range(0, 128)) as c) cc)"""

PIXELS = FRAME + """,
q as (select l_suppkey // 25 as image, (l_orderkey % 128)::int as r, (l_partkey % 128)::int as c, sum(l_quantity) as q
      from lineitem group by 1, 2, 3),
px as (select image, r, c, trunc(least(255, coalesce(q, 0)))::int as v from fr left join q using (image, r, c))"""

RAW = FRAME + """,
q as (select l_suppkey // 25 as image, (l_orderkey % 128)::int as r, (l_partkey % 128)::int as c,
             sum(l_quantity * 4 - 60) as q from lineitem group by 1, 2, 3),
raw as (select image, r, c, coalesce(q, 0)::double as v from fr left join q using (image, r, c))"""

TRUTH_PRED = FRAME + """,
q as (select l_suppkey // 25 as image, (l_orderkey % 128)::int as r, (l_partkey % 128)::int as c, sum(l_quantity) as q,
             sum(case when l_returnflag = 'R' then 51 - l_quantity else l_quantity end) as q2
      from lineitem group by 1, 2, 3),
tp as (select image, r, c, (coalesce(q, 0) >= 20)::int as g, (coalesce(q2, 0) >= 20)::int as p
       from fr left join q using (image, r, c))"""

BANDS = PIXELS + """,
bands as (select image, band::int as band, r, c, ((v * 3 + band * 31 + r * 7 + c) % 256)::int as v
          from px, (select unnest(range(1, 9)) as band) b)"""

BUILDINGS = """b0 as (select p_partkey // 2000 as scene, p_partkey as bid, (p_partkey * 7919) % 1000 as x0,
       (p_partkey * 104729) % 1000 as y0, 2 + p_partkey % 5 + p_size % 2 as w, 2 + p_partkey % 8 as h,
       ((p_partkey % 101) / 100.0)::double as confidence from part),
bld as (select scene, bid, x0, y0, x0 + w as x1, y0 + h as y1, confidence from b0)"""

PREDICTED = BUILDINGS + """,
prd as (select scene, bid as pid, x0 + bid % 3 as x0, y0, x1 + bid % 3 as x1, y1 from bld)"""

AOIS = """aoi as (select s_suppkey // 100 as scene, s_suppkey as aoi, (s_suppkey * 613) % 960 as x0,
       (s_suppkey * 389) % 960 as y0, (s_suppkey * 613) % 960 + 40 as x1, (s_suppkey * 389) % 960 + 40 as y1
       from supplier)"""

MASK = BUILDINGS + """,
mrow as (select scene as image, x0, x1, unnest(range(y0, least(y1, 1000))) as r from bld),
mask as (select distinct image, r::int as r, c::int as c
         from (select image, r, unnest(range(x0, least(x1, 1000))) as c from mrow))"""

PROBS = """z as (select vec_id, vec_id // 100 as tile, list_transform(embedding[1:10], lambda x: x::double * 4) as z, label::int as label,
       1 + (vec_id % 5) / 4.0 as w from embeddings),
ex as (select *, list_transform(z, lambda x: exp(x)) as e from z),
pr as (select vec_id, tile, label, w, list_transform(e, lambda x: x / list_sum(e)) as p from ex),
pl as (select *, p[label + 1] as pt from pr)"""

SCENES = """sc as (select 'scenes/' || c_mktsegment || '/' || name as path, name, done from (
  select c_mktsegment, 'S' || (c_custkey // 2) || case when c_custkey % 2 = 0 then '-M3DS' else '-P3DS' end || '_R1C1.TIF' as name,
         (c_acctbal < 0)::int as done from customer where not (c_custkey % 2 = 1 and c_nationkey < 5)))"""

TASKS = """tk as (select o_orderkey as id, 'img-' || (o_orderkey % 4) || '.TIF' as image_name, o_orderkey % 4 as k,
       ((o_orderkey * 37) % 90)::double as px0, ((o_orderkey * 53) % 90)::double as py0,
       (1 + o_custkey % 10)::double as pw, o_orderpriority as label from orders)"""

ARRIVALS = """ar as (select event_id, ts, user_id % 8 as image, event_type, (value >= 10)::int as g,
       case when (value >= 10) = (event_id % 3 = 0) then 0 else 1 end as p from events)"""

METRIC_SUMS = """sum(p * g)::bigint as n_intersect, sum(p)::bigint as n_pred, sum(g)::bigint as n_truth,
       sum((p = g)::int)::bigint as n_equal"""


def metric_ratios(digits: int) -> str:
    return f"""round(n_intersect / nullif(n_pred, 0), {digits}) as precision, round(n_intersect / nullif(n_truth, 0), {digits}) as recall,
       round(n_equal / nullif(n_pred + n_truth - n_intersect + n_equal - n_intersect, 0), {digits}) as accuracy,
       round(2 * n_intersect / nullif(n_pred + n_truth, 0), {digits}) as dice,
       round(n_intersect / nullif(n_pred + n_truth - n_intersect, 0), {digits}) as iou"""
