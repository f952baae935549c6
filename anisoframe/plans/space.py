"""Queries over many rows: bounds, Morton order, rays, depth, projection, edits, compositing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import fixed, lit
from ..operators import filters, rendering, spatial
from ..operators.filters import POSITION
from .adapter import splats, table
from .registry import S, fx, query
from .rows import P, Q, _iso, _rotated

VIEW = {"position": (0.0, 0.0, 80.0), "right": (1.0, 0.0, 0.0), "up": (0.0, 1.0, 0.0), "back": (0.0, 0.0, 1.0), "fx": 1.5, "fy": 2.0, "near": 1.0, "far": 120.0, "clip": 1.0}
PIXELS = VIEW | {"fx": 600.0, "fy": 600.0}
BOUNDS = [f"{n}_{a}" for n in ("min", "max") for a in P]


def _fixed_bounds(df, *keys):
    return df.select(*keys, *(fixed(F.col(c)).alias(c) for c in BOUNDS))


@query(S + " SELECT " + ", ".join(f"{fx(f'{n}({a})')} AS {n}_{a}" for n in ("min", "max") for a in P) + " FROM s")
def center_bounds(spark, sf_dir):
    return _fixed_bounds(spatial.centre_bounds(splats(spark, sf_dir)))


def _extent(i, cut="0.01"):
    unit = [["1" if n == k else "0" for n in range(3)] for k in range(3)]
    return "(" + "+".join(f"abs({_rotated(Q, unit[k], i)})*{s}*{_iso(cut)}" for k, s in enumerate(("sx", "sy", "sz"))) + ")"


BOXES = f", e AS (SELECT *, {', '.join(f'{_extent(i)} AS e{a}' for i, a in enumerate(P))} FROM s)"
BOX_SQL = ", ".join([fx(f"min({a}-e{a})") + f" AS min_{a}" for a in P] + [fx(f"max({a}+e{a})") + f" AS max_{a}" for a in P])


@query(S + BOXES + f" SELECT segment, {BOX_SQL} FROM e GROUP BY segment")
def full_bounds(spark, sf_dir):
    return _fixed_bounds(spatial.full_bounds(splats(spark, sf_dir), "segment"), "segment")


def _bits(v):
    return "(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i})" for i in range(10)) + ")"


CODED = """, m AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM s),
c AS (SELECT s.*, least(1023, CAST(floor((x-ax)*1024/(bx-ax)) AS BIGINT)) AS cx, least(1023, CAST(floor((y-ay)*1024/(by_-ay)) AS BIGINT)) AS cy, least(1023, CAST(floor((z-az)*1024/(bz-az)) AS BIGINT)) AS cz FROM s, m),
""" + f"k AS (SELECT *, {_bits('cx')} + ({_bits('cy')} << 1) + ({_bits('cz')} << 2) AS morton FROM c), o AS (SELECT *, row_number() OVER (ORDER BY morton, id) - 1 AS rank FROM k)"


@query(S + CODED + " SELECT id, CAST(morton AS BIGINT) AS morton FROM k")
def morton_code(spark, sf_dir):
    return spatial.with_morton(splats(spark, sf_dir)).select("id", "morton")


@query(S + CODED + " SELECT id, rank, rank >> 8 AS block FROM o")
def morton_rank(spark, sf_dir):
    return spatial.morton_ordered(splats(spark, sf_dir)).select("id", "rank", "block")


@query(S + CODED + f", s2 AS (SELECT *, rank >> 8 AS block FROM o), e AS (SELECT *, {', '.join(f'{_extent(i)} AS e{a}' for i, a in enumerate(P))} FROM s2) SELECT block, count(*) AS n, {BOX_SQL} FROM e GROUP BY block")
def block_bounds(spark, sf_dir):
    return _fixed_bounds(spatial.block_bounds(spatial.morton_ordered(splats(spark, sf_dir))), "block", "n")


RAYS_SQL = """r AS (SELECT n_nationkey AS ray_id, CAST(n_nationkey % 5 AS DOUBLE)*8-16 AS ox, CAST(n_nationkey // 5 AS DOUBLE)*8-16 AS oy, -100.0::DOUBLE AS oz,
0.125::DOUBLE*(n_nationkey%3) AS dx, 0.0625::DOUBLE*(n_nationkey%4) AS dy, 2.0::DOUBLE AS dz, 0.0::DOUBLE AS near_, 1000.0::DOUBLE AS far_ FROM nation)"""
_qc = ("(-qx)", "(-qy)", "(-qz)", "qw")
_o = [_rotated(_qc, [f"(o{a}-{a})" for a in P], i) for i in range(3)]
_d = [_rotated(_qc, [f"d{a}" for a in P], i) for i in range(3)]
HITS = f""", {RAYS_SQL}, i AS (SELECT *, {_iso(0.1)} AS iso FROM s WHERE opacity > 0.1), j AS (SELECT ray_id, id, near_, far_, {', '.join(f'{_o[k]}/(s{a}*iso) AS l{a}, {_d[k]}/(s{a}*iso) AS m{a}' for k, a in enumerate(P))} FROM i, r),
q AS (SELECT *, mx*mx+my*my+mz*mz AS a, lx*mx+ly*my+lz*mz AS b, (ly*mz-lz*my)*(ly*mz-lz*my)+(lz*mx-lx*mz)*(lz*mx-lx*mz)+(lx*my-ly*mx)*(lx*my-ly*mx) AS c FROM j),
h AS (SELECT ray_id, id, near_, far_, (-b-sqrt(a-c))/a AS t FROM q WHERE a-c >= 0), hits AS (SELECT ray_id, id, t FROM h WHERE t BETWEEN near_ AND far_)"""


def _rays(spark, sf_dir):
    k = F.col("n_nationkey")
    n = lambda c: c.cast("double")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("ray_id"), (n(k % 5) * lit(8) - lit(16)).alias("ox"), (n(F.floor(k / 5)) * lit(8) - lit(16)).alias("oy"), lit(-100).alias("oz"),
        (lit(0.125) * n(k % 3)).alias("dx"), (lit(0.0625) * n(k % 4)).alias("dy"), lit(2).alias("dz"), lit(0).alias("near"), lit(1000).alias("far"), lit(0.1).alias("min_opacity"),
    )


@query(S + HITS + f" SELECT CAST(ray_id AS BIGINT) AS ray_id, id, {fx('t', 5)} AS t FROM hits")
def raycast_hits(spark, sf_dir):
    hits = spatial.raycast(spatial.morton_ordered(splats(spark, sf_dir)), _rays(spark, sf_dir))
    return hits.select("ray_id", "id", fixed(F.col("t"), 5).alias("t"))


@query(S + HITS + f", f AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, id) AS k, count(*) OVER (PARTITION BY ray_id) AS n_hits FROM hits) SELECT CAST(ray_id AS BIGINT) AS ray_id, id, {fx('t', 5)} AS t, n_hits FROM f WHERE k = 1")
def raycast_nearest(spark, sf_dir):
    hits = spatial.nearest_hits(spatial.raycast(spatial.morton_ordered(splats(spark, sf_dir)), _rays(spark, sf_dir)))
    return hits.select("ray_id", "id", fixed(F.col("t"), 5).alias("t"), "n_hits")


@query(S + ", d AS (SELECT id, 40-z AS depth FROM s WHERE z <= 40) SELECT id, depth, row_number() OVER (ORDER BY depth DESC, id) AS place FROM d")
def depth_axial(spark, sf_dir):
    return rendering.back_to_front(splats(spark, sf_dir), VIEW | {"position": (0.0, 0.0, 40.0)})


@query(S + f", d AS (SELECT id, sqrt(x*x+y*y+(z-40)*(z-40)) AS depth FROM s WHERE z < 40) SELECT id, {fx('depth')} AS depth, row_number() OVER (ORDER BY depth DESC, id) AS place FROM d")
def depth_radial(spark, sf_dir):
    rows = rendering.back_to_front(splats(spark, sf_dir), VIEW | {"position": (0.0, 0.0, 40.0)}, radial=True)
    return rows.select("id", fixed(F.col("depth")).alias("depth"), "place")


@query()
def depth_fast(spark, sf_dir):
    return rendering.back_to_front(splats(spark, sf_dir), VIEW | {"position": (0.0, 0.0, 40.0)}, fast=True)


@query()
def depth_front(spark, sf_dir):
    return rendering.front_to_back(splats(spark, sf_dir), VIEW | {"position": (0.0, 0.0, 40.0)})


@query(S + " SELECT id FROM s WHERE 80-z > 1 AND 80-z < 120 AND abs(x)*1.5::DOUBLE <= 80-z AND abs(y)*2 <= 80-z")
def frustum_cull(spark, sf_dir):
    return splats(spark, sf_dir).where(filters.in_frustum(VIEW)).select("id")


def _project_sql():
    unit = [["1" if n == k else "0" for n in range(3)] for k in range(3)]
    j = [["600*v", "0", "600*v*x*v"], ["0", "600*v", "600*v*y*v"]]
    # v = 1 / depth; the view's third axis points back, so the third entry of the Jacobian is along z.
    p = [["(" + "+".join(f"{_rotated(Q, unit[k], i)}*({j[a][i]})" for i in range(3)) + f")*s{P[k]}" for k in range(3)] for a in range(2)]
    dot = lambda a, b: "+".join(f"({x})*({y})" for x, y in zip(a, b))
    return f"""{S}, w AS (SELECT *, 80-z AS depth, 1/(80-z) AS v FROM s WHERE z < 80), c AS (SELECT id, depth, 600*x*v AS px, 600*y*v AS py, least(opacity, 1.0::DOUBLE) AS al, {dot(p[0], p[0])} AS a, {dot(p[0], p[1])} AS b, {dot(p[1], p[1])} AS d FROM w),
    e AS (SELECT *, (a+0.3::DOUBLE)*(d+0.3::DOUBLE)-b*b AS det, a*d-b*b AS thin FROM c), f AS (SELECT *, al*sqrt(greatest(0.0::DOUBLE, thin/det)) AS alpha FROM e WHERE det > 0)
    SELECT id, {fx('px', 3)} AS px, {fx('py', 3)} AS py, {fx('a+0.3::DOUBLE', 3)} AS cov_xx, {fx('b', 3)} AS cov_xy, {fx('d+0.3::DOUBLE', 3)} AS cov_yy, {fx('alpha', 5)} AS alpha,
    {fx('least(3.0::DOUBLE, sqrt(greatest(0.0::DOUBLE, 2*ln(alpha*255))))*sqrt(0.5::DOUBLE*(a+d+0.6::DOUBLE)+sqrt(0.25::DOUBLE*(a-d)*(a-d)+b*b))', 3)} AS radius1 FROM f WHERE alpha > 0 AND alpha >= 1/255::DOUBLE"""


@query(_project_sql())
def project_cov2d(spark, sf_dir):
    rows = rendering.project(splats(spark, sf_dir), PIXELS)
    return rows.select("id", *(fixed(F.col(c), 3).alias(c) for c in ("px", "py", "cov_xx", "cov_xy", "cov_yy")), fixed(F.col("alpha"), 5).alias("alpha"), fixed(F.col("radius1"), 3).alias("radius1"))


SHAPES = {
    "plane": ({}, "z"), "sphere": ({"radius": 20.0}, "sqrt(x*x+y*y+z*z)-20"),
    "box": ({"size": (10.0, 20.0, 30.0), "radius": 1.0}, "sqrt(pow(greatest(abs(x)-10,0),2)+pow(greatest(abs(y)-20,0),2)+pow(greatest(abs(z)-30,0),2))+least(greatest(abs(x)-10,abs(y)-20,abs(z)-30),0)-1"),
    "ellipsoid": ({"size": (10.0, 20.0, 40.0)}, "CASE WHEN x=0 AND y=0 AND z=0 THEN -10 ELSE sqrt(x*x/100+y*y/400+z*z/1600)*(sqrt(x*x/100+y*y/400+z*z/1600)-1)/sqrt(x*x/10000+y*y/160000+z*z/2560000) END"),
    "cylinder": ({"radius": 15.0, "size": (0.0, 25.0, 0.0)}, "least(greatest(sqrt(x*x+z*z)-15,abs(y)-25),0)+sqrt(pow(greatest(sqrt(x*x+z*z)-15,0),2)+pow(greatest(abs(y)-25,0),2))"),
    "capsule": ({"radius": 15.0, "size": (0.0, 25.0, 0.0)}, "sqrt(x*x+pow(y-least(greatest(y,-25.0::DOUBLE),25.0::DOUBLE),2)+z*z)-15"),
    "cone": ({"size": (0.6, 0.8, 0.0)}, """sqrt(pow(sqrt(x*x+y*y)-0.6::DOUBLE*greatest(sqrt(x*x+y*y)*0.6::DOUBLE-z*0.8::DOUBLE,0),2)+pow(-z-0.8::DOUBLE*greatest(sqrt(x*x+y*y)*0.6::DOUBLE-z*0.8::DOUBLE,0),2))
        *CASE WHEN sqrt(x*x+y*y)*0.8::DOUBLE+z*0.6::DOUBLE < 0 THEN -1 ELSE 1 END"""),
}


@query(S + " SELECT id, " + ", ".join(f"{fx(e, 4)} AS d_{n}" for n, (_, e) in SHAPES.items()) + " FROM s")
def sdf_distances(spark, sf_dir):
    return splats(spark, sf_dir).select("id", *(fixed(rendering.shape_distance(n, list(POSITION), **a), 4).alias(f"d_{n}") for n, (a, _) in SHAPES.items()))


EDITS = [
    {"blend": "mul", "soft": 4.0, "selections": [{"shape": "sphere", "radius": 20.0, "rgba": (0.5, 0.25, 1.0, 0.5), "mask": (1, 1, 0, 1)}]},
    {"blend": "set", "invert": True, "selections": [{"shape": "box", "size": (40.0, 40.0, 40.0), "rgba": (1.0, 0.0, 0.0, 0.25), "mask": (1, 0, 0, 1)}]},
    {"blend": "add", "smooth": 8.0, "soft": 8.0, "selections": [
        {"shape": "sphere", "centre": (30.0, 0.0, 0.0), "radius": 10.0, "rgba": (0.0, 0.5, 0.0, 0.0), "mask": (0, 1, 0, 0)},
        {"shape": "sphere", "centre": (0.0, 30.0, 0.0), "radius": 12.0, "rgba": (0.0, 0.0, 0.5, 0.0), "mask": (0, 0, 1, 0)}]},
]
_f1 = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE-(sqrt(x*x+y*y+z*z)-20)/4))"
_box = "(sqrt(pow(greatest(abs(x)-40,0),2)+pow(greatest(abs(y)-40,0),2)+pow(greatest(abs(z)-40,0),2))+least(greatest(abs(x),abs(y),abs(z))-40,0))"


@query(S + f""", e1 AS (SELECT id, x, y, z, r*(1-0.5::DOUBLE*{_f1}) AS r, g*(1-0.75::DOUBLE*{_f1}) AS g, b, opacity*(1-0.5::DOUBLE*{_f1}) AS opacity FROM s),
e2 AS (SELECT id, x, y, z, CASE WHEN -{_box} < 0 THEN 1.0::DOUBLE ELSE r END AS r, g, b, CASE WHEN -{_box} < 0 THEN 0.25::DOUBLE ELSE opacity END AS opacity FROM e1),
d AS (SELECT *, sqrt((x-30)*(x-30)+y*y+z*z)-10 AS d1, sqrt(x*x+(y-30)*(y-30)+z*z)-12 AS d2 FROM e2),
w AS (SELECT *, exp(-d1/8-greatest(-d1/8,-d2/8)) AS w1, exp(-d2/8-greatest(-d1/8,-d2/8)) AS w2 FROM d), u AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE+(ln(w1+w2)+greatest(-d1/8,-d2/8))*8/8)) AS f FROM w)
SELECT id, {fx('r')} AS r, {fx('g+f*0.5::DOUBLE*w1/(w1+w2)')} AS g, {fx('b+f*0.5::DOUBLE*w2/(w1+w2)')} AS b, {fx('opacity')} AS opacity FROM u""")
def edit_chain(spark, sf_dir):
    new = rendering.edited(EDITS)
    return splats(spark, sf_dir).select("id", *(fixed(c).alias(k) for k, c in new.items()))


FRAGMENTS = "f AS (SELECT CAST(floor((x+64)/16) AS BIGINT) AS px, CAST(floor((y+64)/16) AS BIGINT) AS py, z+70 AS depth, id, least(opacity, 1.0::DOUBLE)*0.0625::DOUBLE AS alpha, r, g, b FROM s)"


@query(S + f""", {FRAGMENTS}, t AS (SELECT *, exp(coalesce(sum(ln(1-alpha)) OVER (PARTITION BY px, py ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM f)
SELECT px, py, {', '.join(f"{fx(f'sum(t*alpha*{c})')} AS {c}" for c in 'rgb')}, {fx('1-exp(sum(ln(1-alpha)))')} AS coverage, count(*) AS n FROM t GROUP BY px, py""")
def composite_over(spark, sf_dir):
    at = lambda c: F.floor((F.col(c) + lit(64)) / lit(16))
    rows = splats(spark, sf_dir).select("id", "r", "g", "b", at("x").alias("px"), at("y").alias("py"), (F.col("z") + lit(70)).alias("depth"), (F.least("opacity", lit(1)) * lit(0.0625)).alias("alpha"))
    out = rendering.composite(rows, ["px", "py"])
    return out.select("px", "py", *(fixed(F.col(c)).alias(c) for c in ("r", "g", "b", "coverage")), F.col("n").cast("long").alias("n"))


@query(S + ", p AS (SELECT id // 100 AS px, id % 100 AS py, CAST(r*255 AS DOUBLE) AS v FROM s) SELECT px // 4 AS px, py // 4 AS py, CAST(floor(avg(v)+0.5::DOUBLE) AS BIGINT) AS v FROM p GROUP BY 1, 2")
def downsample(spark, sf_dir):
    rows = splats(spark, sf_dir).select(F.floor(F.col("id") / 100).alias("px"), (F.col("id") % 100).alias("py"), (F.col("r") * lit(255)).alias("v"))
    return rendering.downsample(rows, 4, ("v",))
