"""Queries of codebooks, spatial partitions, merges, trees and cuts, and of the streaming rules in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import fixed, lit
from ..operators import codebooks, lod, merging, spatial
from ..streaming import schedule
from .adapter import splats, table
from .registry import S, fx, query
from .rows import AREA, COV, PAIRS, WIDER, P, _cov
from .space import CODED


@query(S + """, e AS (SELECT segment, min(x) AS lo, max(x) AS hi FROM s GROUP BY segment) SELECT s.segment, CAST(floor((x-lo)/(hi-lo)*65535+0.5::DOUBLE) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight, CAST(sum(x) AS DOUBLE) AS total FROM s JOIN e USING (segment) GROUP BY 1, 2""")
def quantize_hist(spark, sf_dir):
    return codebooks.histogram(splats(spark, sf_dir), "x", key="segment")


@query()
def scalar_codebook(spark, sf_dir):
    books = codebooks.scalar_codebooks(splats(spark, sf_dir), "x", importance=0.25, key="segment")
    rows = splats(spark, sf_dir).join(books, "segment")
    return rows.select("id", codebooks.scalar_label(F.col("x"), F.col("codebook")).alias("label"))


@query(S + """, w AS (SELECT id, opacity, sum(opacity) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS t FROM s WHERE opacity < 1.5)
SELECT id, opacity AS weight FROM s WHERE opacity >= 1.5 UNION ALL SELECT id, 1.5::DOUBLE FROM w WHERE floor(t/1.5::DOUBLE+0.5::DOUBLE) > floor((t-opacity)/1.5::DOUBLE+0.5::DOUBLE)""")
def pps_sample(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", F.col("opacity").alias("weight"))
    return codebooks.weighted_sample(rows, "weight", ["id"], step=1.5).select("id", "weight")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"""WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), n AS (SELECT id, v, row_number() OVER (ORDER BY id)-1 AS k, count(*) OVER () AS n, (count(*) OVER () + 7)//8 AS m FROM v),
c AS (SELECT e AS label, v AS code FROM n, range(262144) t(e) WHERE e < m AND k = (e*n)//m), d AS (SELECT id, v, min(struct_pack(d := list_distance(v, code), label := label)).label AS label FROM v, c GROUP BY id, v),
u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM d) SELECT CAST(label AS INTEGER) AS label, i, count(*) AS n, {fx('avg(x)')} AS mean FROM u GROUP BY 1, 2""")
def kmeans_step(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    labelled = codebooks.nearest_codes(rows, codebooks.seeds(rows, codebooks.codebook_size(rows.count())))
    out = codebooks.means(labelled, lit(1)).select("label", "n", F.posexplode("mean").alias("k", "m"))
    return out.select("label", (F.col("k") + 1).cast("long").alias("i"), "n", fixed(F.col("m")).alias("mean"))


@query()
def kmeans(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    _, labelled = codebooks.k_means(rows, codebooks.seeds(rows, codebooks.codebook_size(rows.count())), 10)
    return labelled.select("id", "label", fixed(F.col("distance")).alias("distance"))


@query("SELECT o.o_orderkey AS id, e.vec_id AS label, CAST(e.label AS INTEGER) AS tag FROM orders o JOIN embeddings e ON o.o_orderkey % 500 = e.vec_id")
def palette_join(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500).alias("label"))
    palette = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.col("label").alias("tag"))
    return codebooks.with_palette(rows, palette).where("tag IS NOT NULL")


@query(S + " SELECT sx, sy, sz, count(*) AS n FROM s GROUP BY ALL")
def distinct_codes(spark, sf_dir):
    return codebooks.distinct_codes(splats(spark, sf_dir), ["sx", "sy", "sz"])


@query("SELECT o_orderkey AS id, CAST((o_custkey * 7) % 256 AS BIGINT) AS value FROM orders")
def delta_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.shiftright("o_orderkey", 10).alias("chunk"), ((F.col("o_custkey") * 7) % 256).alias("v"))
    return codebooks.delta_decoded(codebooks.delta_encoded(rows, "v", "chunk", "id").drop("v"), "chunk", "id").select("id", "value")


@query(S + " SELECT quantile_disc(r, 0.01) AS low, quantile_disc(r, 0.99) AS high FROM s")
def encoding_range(spark, sf_dir):
    return codebooks.encoding_range(splats(spark, sf_dir), F.col("r"))


@query("""WITH RECURSIVE t(n) AS (SELECT count(*) FROM orders UNION ALL SELECT greatest(1, least(n-1, CAST(ceil(n/4.0::DOUBLE) AS BIGINT))) FROM t WHERE n > 100 AND n > 1)
SELECT row_number() OVER (ORDER BY n DESC) - 1 AS level, n FROM t""")
def level_targets(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    return spark.createDataFrame([*enumerate([n, *lod.level_targets(n, 100)])], "level long, n long")


@query(S + """, e AS (SELECT segment, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM s GROUP BY segment),
u AS (SELECT segment, 0 AS axis, x AS v, ax AS lo, bx AS hi FROM s JOIN e USING (segment) UNION ALL SELECT segment, 1, y, ay, by_ FROM s JOIN e USING (segment) UNION ALL SELECT segment, 2, z, az, bz FROM s JOIN e USING (segment))
SELECT segment AS node, axis, least(255, CAST(floor((v-lo)*256/(hi-lo)) AS BIGINT)) AS bin, count(*) AS n, min(v) AS low, max(v) AS high FROM u GROUP BY 1, 2, 3""")
def kd_bins(spark, sf_dir):
    return lod.axis_bins(splats(spark, sf_dir).withColumnRenamed("segment", "node"))


def _running(k: str, frame: str) -> str:
    return ", ".join([f"sum(n) OVER {frame} AS {k}n", *(f"{f}({f}_{a}) OVER {frame} AS {k}_{f}_{a}" for f in ("min", "max") for a in P)])


_LENGTHS = ", ".join(f"greatest(eps, {k}_max_{a} - {k}_min_{a}) AS {k}{a}" for k in "lrp" for a in P)
_SURFACE = {k: f"2 * ({k}x * {k}y + {k}x * {k}z + {k}y * {k}z)" for k in "lrp"}
_AXES = " UNION ALL ".join(f"SELECT s.segment, {i} AS axis, s.{a} AS v, lo{a} AS lo, hi{a} AS hi, eps, x, y, z FROM s JOIN e USING (segment)" for i, a in enumerate(P))


@query(S + f""", f AS (SELECT segment, {', '.join(f'min({a}) AS lo{a}, max({a}) AS hi{a}' for a in P)} FROM s GROUP BY segment), e AS (SELECT *, greatest(greatest(hix - lox, hiy - loy, hiz - loz) * 1e-9, 1e-9) AS eps FROM f),
u AS ({_AXES}), b AS (SELECT segment, axis, least(255, CAST(floor((v - lo) / (hi - lo) * 256) AS BIGINT)) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(eps) AS eps, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}' for a in P)} FROM u WHERE hi - lo > eps GROUP BY 1, 2, 3),
w AS (SELECT *, {_running('l', '(PARTITION BY segment, axis ORDER BY bin ROWS UNBOUNDED PRECEDING)')}, {_running('r', '(PARTITION BY segment, axis ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)')}, {_running('p', '(PARTITION BY segment, axis)')}, max(hi - lo) OVER (PARTITION BY segment) AS longest FROM b),
d AS (SELECT *, {_LENGTHS} FROM w WHERE rn IS NOT NULL), c AS (SELECT segment, axis, bin, lo + (hi - lo) * (bin + 1) / 256 AS cut, ({_SURFACE['l']} * ln + {_SURFACE['r']} * rn) / ({_SURFACE['p']} * pn) * (lx * ly * lz + rx * ry * rz) / (px * py * pz) * sqrt(longest / (hi - lo)) AS score FROM d)
SELECT segment AS node, axis, bin, {fx('cut')} AS cut FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score, axis, bin) = 1""")
def area_cuts(spark, sf_dir):
    rows = splats(spark, sf_dir).withColumnRenamed("segment", "node")
    return lod.area_cuts(lod.box_bins(rows)).select("node", "axis", "bin", fixed(F.col("cut")).alias("cut"))


@query()
def kd_regions(spark, sf_dir):
    out = lod.regions(splats(spark, sf_dir), 1000)
    return out.groupBy("region").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE l AS (SELECT CAST(s_suppkey AS BIGINT) AS leaf, CAST(s_suppkey % 3 AS INTEGER) AS level, CAST((s_suppkey*37) % 90 + 10 AS BIGINT) AS size, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS k FROM supplier),
f AS (SELECT leaf, level, size, k, CAST(0 AS BIGINT) AS chunk, size AS used FROM l WHERE k = 1 UNION ALL
SELECT l.leaf, l.level, l.size, l.k, CASE WHEN used + l.size > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN used + l.size > 200 THEN l.size ELSE used + l.size END FROM f JOIN l ON l.level = f.level AND l.k = f.k + 1) SELECT level, leaf, chunk FROM f""")
def pack_leaves(spark, sf_dir):
    k = F.col("s_suppkey")
    leaves = table(spark, sf_dir, "supplier").select(k.cast("long").alias("leaf"), (k % 3).cast("int").alias("level"), ((k * 37) % 90 + 10).alias("size"))
    return lod.packed_leaves(leaves, 200)


W = f"({AREA})*opacity"


@query(S + f""", c AS (SELECT *, {W} AS w, {', '.join(f'{_cov(i, j)} AS {n}' for n, (i, j) in zip(COV, PAIRS))} FROM s), m AS (SELECT segment, count(*) AS n, sum(w) AS ww, {', '.join(f'sum(w*{a})/sum(w) AS m{a}' for a in (*P, *'rgb'))} FROM c GROUP BY segment)
SELECT segment, any_value(m.n) AS n, {fx('any_value(ww)', 2)} AS weight, {', '.join(f'{fx(f"any_value(m{a})", 5)} AS {a}' for a in (*P, *'rgb'))},
{', '.join(f'{fx(f"sum(w*({n}+({P[i]}-m{P[i]})*({P[j]}-m{P[j]})))/any_value(ww)", 4)} AS {n}' for n, (i, j) in zip(COV, PAIRS))} FROM c JOIN m USING (segment) GROUP BY segment""")
def merge_moments(spark, sf_dir):
    m = lod.merged_moments(splats(spark, sf_dir), "segment")
    return m.select("segment", "n", fixed(F.col("weight"), 2).alias("weight"), *(fixed(F.col(c), 5).alias(c) for c in (*P, *"rgb")), *(fixed(F.col(c), 4).alias(c) for c in COV))


@query()
def merge_groups(spark, sf_dir):
    m = lod.merge_groups(splats(spark, sf_dir), "segment")
    return m.select("segment", "n", *(fixed(F.col(c), 3).alias(c) for c in ("x", "y", "z", "sx", "sy", "sz", "opacity")))


@query()
def merge_round(spark, sf_dir):
    return merging.merge_round(splats(spark, sf_dir)).select("id", *(fixed(F.col(c), 3).alias(c) for c in ("x", "y", "z", "opacity")))


REPS = "r AS (SELECT s.id AS rep, x AS rx, y AS ry, z AS rz FROM s JOIN (SELECT min(id) AS id FROM s GROUP BY floor(x/20), floor(y/20), floor(z/20)) USING (id))"


@query(S + f""", {REPS}, d AS (SELECT id, rep, sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)+(z-rz)*(z-rz)) AS d FROM s, r), k AS (SELECT id, min(struct_pack(d := d, rep := rep)) AS k FROM d GROUP BY id)
SELECT id, k.rep AS rep, {fx('k.d')} AS distance FROM k""")
def nn_assign(spark, sf_dir):
    rows = splats(spark, sf_dir)
    found = lod.assigned_in_tiers(rows, lod.first_of_cells(rows, 20.0), [10.0, 20.0, 40.0])
    return found.select("id", "rep", fixed(F.col("distance")).alias("distance"))


def _det(p):
    xx, xy, xz, yy, yz, zz = (f"{p}{c[1:]}" for c in COV)
    return f"({xx}*({yy}*{zz}-{yz}*{yz})-{xy}*({xy}*{zz}-{yz}*{xz})+{xz}*({xy}*{yz}-{yy}*{xz}))"


def _quad(p):
    xx, xy, xz, yy, yz, zz = (f"{p}{c[1:]}" for c in COV)
    return f"""((({yy}*{zz}-{yz}*{yz})*dx*dx+({xx}*{zz}-{xz}*{xz})*dy*dy+({xx}*{yy}-{xy}*{xy})*dz*dz+2*(({xz}*{yz}-{xy}*{zz})*dx*dy+({xy}*{yz}-{xz}*{yy})*dx*dz+({xy}*{xz}-{xx}*{yz})*dy*dz))/{_det(p)})"""


@query(S + f""", c AS (SELECT id, x, y, z, r, g, b, {', '.join(f'{_cov(i, j)} AS {n}' for n, (i, j) in zip(COV, PAIRS))} FROM s),
p AS (SELECT a.id, {', '.join(f'a.{n} AS a{n[1:]}, b.{n} AS b{n[1:]}, (a.{n}+b.{n})/2 AS m{n[1:]}' for n in COV)}, a.x-b.x AS dx, a.y-b.y AS dy, a.z-b.z AS dz, (a.r-b.r)*(a.r-b.r)+(a.g-b.g)*(a.g-b.g)+(a.b-b.b)*(a.b-b.b) AS dc FROM c a JOIN c b ON b.id = a.id + 1)
SELECT id, {fx(f"least(0, 0.25::DOUBLE*ln({_det('a')})+0.25::DOUBLE*ln({_det('b')})-0.5::DOUBLE*ln({_det('m')})-{_quad('m')}/8)-dc", 4)} AS score FROM p""")
def bhattacharyya_pair(spark, sf_dir):
    rows = lod.with_covariance(splats(spark, sf_dir)).select("id", *P, *"rgb", *COV)
    other = rows.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"o_{c}") for c in (*P, *"rgb", *COV)))
    own, theirs = (([F.col(f"{p}{c}") for c in P], [F.col(f"{p}{c}") for c in COV], [F.col(f"{p}{c}") for c in "rgb"]) for p in ("", "o_"))
    return rows.join(other, "id").select("id", fixed(G.log_similarity(*own, *theirs), 4).alias("score"))


_SIDE = 8.0
_NEAR = " AND ".join(f"b.c{a} BETWEEN a.c{a} - 1 AND a.c{a} + 1" for a in P)


@query(S + f""", c AS (SELECT id, x, y, z, r, g, b, {', '.join(f'CAST(floor({a}/{_SIDE}) AS BIGINT) AS c{a}' for a in P)}, {', '.join(f'{_cov(i, j)} AS {n}' for n, (i, j) in zip(COV, PAIRS))} FROM s),
p AS (SELECT a.id, {', '.join(f'a.{n} AS a{n[1:]}, b.{n} AS b{n[1:]}, (a.{n}+b.{n})/2 AS m{n[1:]}' for n in COV)}, a.x-b.x AS dx, a.y-b.y AS dy, a.z-b.z AS dz, (a.r-b.r)*(a.r-b.r)+(a.g-b.g)*(a.g-b.g)+(a.b-b.b)*(a.b-b.b) AS dc FROM c a JOIN c b ON {_NEAR} AND a.id <> b.id)
SELECT id, {fx(f"max(least(0, 0.25::DOUBLE*ln({_det('a')})+0.25::DOUBLE*ln({_det('b')})-0.5::DOUBLE*ln({_det('m')})-{_quad('m')}/8)-dc)", 4)} AS score FROM p GROUP BY id""")
def partner_scores(spark, sf_dir):
    return merging.best_partners(splats(spark, sf_dir), _SIDE).select("id", fixed(F.col("score"), 4).alias("score"))


TREE = CODED + f", n AS (SELECT l AS level, morton >> (30-3*l) AS node, count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, max(2*greatest(sx,sy,sz)*{WIDER}) AS feature FROM k, range(4) t(l) GROUP BY 1, 2)"
LEVELS = 3


def _tree(spark, sf_dir):
    return lod.morton_tree(spatial.with_morton(splats(spark, sf_dir)), LEVELS)


@query(S + TREE + f" SELECT CAST(level AS INTEGER) AS level, CAST(node AS BIGINT) AS node, n, min_x, max_z, {fx('feature')} AS feature FROM n")
def tree_rollup(spark, sf_dir):
    return _tree(spark, sf_dir).select("level", "node", "n", "min_x", "max_z", fixed(F.col("feature")).alias("feature"))


def _keep_sql():
    parts = ["k3 AS (SELECT node, true AS kept, feature AS up FROM n WHERE level = 3)"]
    for level in (2, 1, 0):
        parts.append(f"c{level} AS (SELECT node >> 3 AS node, max(up) AS child FROM k{level + 1} GROUP BY 1)")
        keep = "true" if level == 0 else "feature >= 1.05::DOUBLE*child"
        parts.append(f"k{level} AS (SELECT n.node, {keep} AS kept, CASE WHEN {keep} THEN feature ELSE child END AS up FROM n JOIN c{level} USING (node) WHERE level = {level})")
    return S + TREE + ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS level, CAST(node AS BIGINT) AS node, kept FROM k{i}" for i in range(4))


@query(_keep_sql())
def tree_keep(spark, sf_dir):
    return lod.kept_nodes(_tree(spark, sf_dir), 1.05, LEVELS)


def _distances(spark, sf_dir, view):
    nodes = _tree(spark, sf_dir).withColumns({c: lit(v) for c, v in zip(("vx", "vy", "vz", "ax", "ay", "az"), view)})
    return nodes.withColumn("distance", lod.view_distance()).select("level", "node", "distance")


VIEWS = ((0.0, 0.0, 100.0, 0.0, 0.0, -1.0), (100.0, 0.0, 0.0, -1.0, 0.0, 0.0))


def _cut_sql(view, name):
    d = "greatest(1e-6, sqrt(" + "+".join(f"pow(least(greatest({v}::DOUBLE, min_{a}), max_{a})-({v}::DOUBLE), 2)" for a, v in zip(P, view)) + "))"
    parts = [f"{name}d AS (SELECT level, node, ln({d}/64)-(2-level)*ln(2::DOUBLE) AS k FROM n)", f"{name}0 AS (SELECT 0 AS level, node, k FROM {name}d WHERE level = 0)"]
    for i in (1, 2, 3):
        parts.append(f"{name}{i} AS (SELECT {i} AS level, d.node, greatest(d.k, p.k) AS k FROM {name}d d JOIN {name}{i - 1} p ON d.node >> 3 = p.node WHERE d.level = {i})")
    union = " UNION ALL ".join(f"SELECT level, node, round(k, 9) AS k FROM {name}{i}" for i in range(4))
    parts += [
        f"{name}a AS ({union})", f"{name}c AS (SELECT level-1 AS level, node >> 3 AS node, count(*) AS c FROM {name}a WHERE level > 0 GROUP BY 1, 2)",
        f"{name}i AS (SELECT a.level, a.node, a.k, c.c FROM {name}a a JOIN {name}c c ON a.level = c.level AND a.node = c.node)",
        f"{name}s AS (SELECT k, sum(sum(c-1)) OVER (ORDER BY k) AS t FROM {name}i GROUP BY k)",
        f"{name}r AS (SELECT level, node FROM {name}i WHERE k IN (SELECT k FROM {name}s WHERE t + 1 <= 200))",
        f"{name}x AS (SELECT CAST(a.level AS INTEGER) AS level, CAST(a.node AS BIGINT) AS node FROM {name}a a WHERE (a.level = 0 OR EXISTS (SELECT 1 FROM {name}r r WHERE r.level = a.level-1 AND r.node = a.node >> 3)) AND NOT EXISTS (SELECT 1 FROM {name}r r WHERE r.level = a.level AND r.node = a.node))",
    ]
    return ", ".join(parts)


@query(S + TREE + ", " + _cut_sql(VIEWS[0], "p") + " SELECT * FROM px")
def cut_target(spark, sf_dir):
    return lod.budgeted_cut(_distances(spark, sf_dir, VIEWS[0]), 200, LEVELS)


@query(S + TREE + ", " + _cut_sql(VIEWS[0], "p") + ", " + _cut_sql(VIEWS[1], "q") + " SELECT coalesce(a.level, b.level) AS level, coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'incoming' WHEN b.node IS NULL THEN 'outgoing' ELSE 'shared' END AS change FROM px a FULL JOIN qx b ON a.level = b.level AND a.node = b.node")
def cut_diff(spark, sf_dir):
    cuts = [lod.budgeted_cut(_distances(spark, sf_dir, v), 200, LEVELS) for v in VIEWS]
    return lod.cut_difference(*cuts, ["level", "node"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return schedule.windowed(table(spark, sf_dir, "events"), "1 hour")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30*k) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS cents FROM events, range(2) t(k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return schedule.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return schedule.sessions(table(spark, sf_dir, "events"), "1 hour")


@query("SELECT event_id, CAST(least(30000, 1000 * pow(2, least(event_id % 40, 16))) AS BIGINT) AS delay, (event_id % 7 = 0 OR event_id % 600 IN (408, 425, 429) OR event_id % 600 >= 500) AS again FROM events")
def retry_schedule(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 7 != 0, i % 600)
    return table(spark, sf_dir, "events").select("event_id", schedule.retry_delay(i % 40).alias("delay"), schedule.retryable(status).alias("again"))


@query(f"SELECT event_id, {fx('value + (1-value)*least(1.0::DOUBLE, (event_id%400)/200.0::DOUBLE)')} AS opacity FROM events")
def fade_curve(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", fixed(schedule.faded(i % 400, F.lit(0), F.col("value"), lit(1))).alias("opacity"))


@query("""WITH v AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM v) SELECT event_id, user_id, event_type, revision FROM r WHERE new = 1""")
def view_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return schedule.view_changes(rows, ["event_type"], "user_id", "event_id")


@query("""WITH e AS (SELECT event_id % 50 AS page, event_id * 37 + (event_id % 7) * 200 AS a FROM events), g AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY page ORDER BY a) <= 2000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT page, min(a) AS since, max(a) + 2000 AS released FROM s GROUP BY page, k""")
def cooldown(spark, sf_dir):
    i = F.col("event_id")
    return schedule.releases(table(spark, sf_dir, "events").select((i % 50).alias("page"), (i * 37 + (i % 7) * 200).alias("at")))
