"""Queries on single rows: filters, the expression language, codecs and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, expressions
from ..functions import geometry as G
from ..functions import scalars as N
from ..functions import vectors as V
from ..functions.scalars import fixed, lit
from ..operators import filters
from ..operators.filters import COLOUR, POSITION, ROTATION, SCALE
from .adapter import splats, table
from .registry import S, fx, query

SPHERE = (0.0, 0.0, 0.0, 40.0)
NAN = "CAST('NaN' AS DOUBLE)"
BROKEN = f"CASE WHEN id % 97 = 0 THEN {NAN} ELSE x END AS x, y, z, CASE WHEN id % 89 = 0 THEN -opacity WHEN id % 83 = 0 THEN CAST(0 AS DOUBLE) ELSE opacity END AS opacity"
R = "sqrt(x*x+y*y+z*z)"


@query(S + f""", b AS (SELECT id, {BROKEN} FROM s)
SELECT CASE WHEN isnan(x) OR opacity < 0 THEN 'INVALID' WHEN opacity = 0 THEN 'EMPTY' WHEN {R} > 40 THEN 'CROPPED' ELSE 'KEEP' END AS reason, count(*) AS n
FROM b GROUP BY 1""")
def retain_counts(spark, sf_dir):
    rows = splats(spark, sf_dir)
    rows = rows.withColumn("x", F.when(F.col("id") % 97 == 0, lit(N.NAN)).otherwise(F.col("x")))
    opacity = F.when(F.col("id") % 89 == 0, -F.col("opacity")).when(F.col("id") % 83 == 0, lit(0)).otherwise(F.col("opacity"))
    return filters.retain_counts(rows.withColumn("opacity", opacity), SPHERE)


@query(S + f" SELECT id, x, y, z FROM s WHERE {R} <= 40")
def crop_sphere(spark, sf_dir):
    return filters.retain(splats(spark, sf_dir), SPHERE).select("id", "x", "y", "z")


@query(S + f""" SELECT id, {fx('x + y*z - (x+1)*0.5::DOUBLE')} AS a, CASE WHEN z = 0 THEN NULL ELSE {fx('x / z')} END AS b,
{fx('least(greatest(x, -10.0::DOUBLE), 10.0::DOUBLE)')} AS c, {fx('x + (y-x)*opacity')} AS d, {fx('CASE WHEN x>=0 THEN floor(x+0.5::DOUBLE) ELSE -floor(-x+0.5::DOUBLE) END')} AS e,
{fx('floor(y)')} AS f, {fx('ceil(z)')} AS g FROM s""")
def dsl_arith(spark, sf_dir):
    o, s = expressions.Operations(), expressions.Fields()
    x, y, z = (o.component(s.position, i) for i in range(3))
    values = {
        "a": o.sub(o.add(x, o.mul(y, z)), o.mul(o.add(x, 1), 0.5)), "b": o.div(x, z), "c": o.clamp(x, -10, 10), "d": o.mix(x, y, s.opacity),
        "e": o.round(x), "f": o.floor(y), "g": o.ceil(z),
    }
    finite = lambda c: F.when(N.is_finite(c), fixed(F.when(N.is_finite(c), c)))
    return splats(spark, sf_dir).select("id", *(finite(v.parts[0]).alias(k) for k, v in values.items()))


@query(S + f""" SELECT id, {fx('sin(x)')} AS a, {fx('cos(y)')} AS b, {fx('atan2(y, x)')} AS c, {fx('asin(r)')} AS d, {fx('acos(g)')} AS e, {fx('atan(z)')} AS f,
{fx('exp(opacity)')} AS g, {fx('ln(opacity)')} AS h, {fx('sqrt(opacity)')} AS i, {fx('pow(opacity, 1.5::DOUBLE)')} AS j, {fx('tan(r)')} AS k FROM s""")
def dsl_trig(spark, sf_dir):
    o, s = expressions.Operations(), expressions.Fields()
    (x, y, z), w = (o.component(s.position, i) for i in range(3)), s.opacity
    r, g = (expressions.Value("float", (F.col(c),)) for c in "rg")
    values = dict(a=o.sin(x), b=o.cos(y), c=o.atan2(y, x), d=o.asin(r), e=o.acos(g), f=o.atan(z), g=o.exp(w), h=o.log(w), i=o.sqrt(w), j=o.pow(w, 1.5), k=o.tan(r))
    return splats(spark, sf_dir).select("id", *(fixed(v.parts[0]).alias(k) for k, v in values.items()))


@query(S + f""" SELECT id, {fx(f'CASE WHEN {R} > 0 THEN x/{R} ELSE x END')} AS nx, {fx(R)} AS len, {fx('x*sx+y*sy+z*sz')} AS dotp,
{fx('y*sz-z*sy')} AS cx, {fx('z*sx-x*sz')} AS cy, {fx('x*sy-y*sx')} AS cz,
CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS axis FROM s""")
def dsl_vector(spark, sf_dir):
    o, s = expressions.Operations(), expressions.Fields()
    n, c = o.normalize(s.position), o.cross(s.position, s.scale)
    out = {"nx": n.parts[0], "len": o.length(s.position).parts[0], "dotp": o.dot(s.position, s.scale).parts[0], "cx": c.parts[0], "cy": c.parts[1], "cz": c.parts[2]}
    axis = o.maxComponentIndex(s.position).parts[0].cast("int").alias("axis")
    return splats(spark, sf_dir).select("id", *(fixed(v).alias(k) for k, v in out.items()), axis)


def _rotated(q, v, i):
    """SQL of component i of v turned by q, through the rotation matrix."""
    x, y, z, w = q
    m = [[f"1-2*({y}*{y}+{z}*{z})", f"2*({x}*{y}-{w}*{z})", f"2*({x}*{z}+{w}*{y})"], [f"2*({x}*{y}+{w}*{z})", f"1-2*({x}*{x}+{z}*{z})", f"2*({y}*{z}-{w}*{x})"], [f"2*({x}*{z}-{w}*{y})", f"2*({y}*{z}+{w}*{x})", f"1-2*({x}*{x}+{y}*{y})"]]
    return "(" + "+".join(f"({m[i][k]})*{v[k]}" for k in range(3)) + ")"


Q, P = ("qx", "qy", "qz", "qw"), ("x", "y", "z")


@query(S + f""" SELECT id, {', '.join(f'{fx(_rotated(Q, P, i))} AS r{P[i]}' for i in range(3))},
{fx('0.5::DOUBLE*qx + 0.5::DOUBLE*qw + 0.5::DOUBLE*qz - 0.5::DOUBLE*qy')} AS px, {fx('0.5::DOUBLE*qw - 0.5::DOUBLE*qx - 0.5::DOUBLE*qy - 0.5::DOUBLE*qz')} AS pw FROM s""")
def dsl_quat(spark, sf_dir):
    o, s = expressions.Operations(), expressions.Fields()
    r, p = o.rotateVector(s.quaternion, s.position), o.quatMul(o.quaternion(0.5, 0.5, 0.5, 0.5), s.quaternion)
    return splats(spark, sf_dir).select("id", *(fixed(c).alias(f"r{a}") for a, c in zip(P, r.parts)), fixed(p.parts[0]).alias("px"), fixed(p.parts[3]).alias("pw"))


@query(S + f""", t AS (SELECT *, (x > 0 AND opacity < 1) OR z <= -50 AS hit FROM s)
SELECT id, {fx('CASE WHEN hit THEN x+1 ELSE x END')} AS x, {fx('CASE WHEN hit THEN y*2 ELSE y END')} AS y, {fx('CASE WHEN hit THEN opacity*0.5::DOUBLE ELSE opacity END')} AS opacity, {fx('CASE WHEN hit THEN sx*2 ELSE sx END')} AS sx FROM t""")
def dsl_when(spark, sf_dir):
    program = expressions.define(lambda s, o, attribute: {
        "when": o.or_(o.and_(o.gt(o.component(s.position, 0), 0), o.lt(s.opacity, 1)), o.lte(o.component(s.position, 2), -50)),
        "position": o.vec3(o.add(o.component(s.position, 0), 1), o.mul(o.component(s.position, 1), 2), o.component(s.position, 2)),
        "scale": o.mul(s.scale, 2), "opacity": o.mul(s.opacity, 0.5),
    })
    return program.apply(splats(spark, sf_dir)).select("id", *(fixed(F.col(c)).alias(c) for c in ("x", "y", "opacity", "sx")))


@query(S + f""" SELECT s.id, {fx('CASE WHEN c.c_custkey IS NULL THEN s.x ELSE s.x + c.c_acctbal END', 3)} AS x FROM s LEFT JOIN customer c ON s.id = c.c_custkey""")
def dsl_attr(spark, sf_dir):
    program = expressions.define(lambda s, o, attribute: {"position": o.add(
        s.position, o.vec3(attribute(table(spark, sf_dir, "customer"), "c_acctbal", key="c_custkey"), 0, 0))})
    return program.apply(splats(spark, sf_dir)).select("id", fixed(F.col("x"), 3).alias("x"))


SHAPE = "CASE WHEN opacity > 1 THEN least(0.25::DOUBLE*(sqrt(exp(1::DOUBLE)*ln(opacity)+1)-1), 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


@query(S + f""", c AS (SELECT id, least(opacity, 1.0::DOUBLE) AS alpha, {SHAPE} AS shape FROM s)
SELECT id, {fx('alpha')} AS alpha, {fx('shape')} AS shape, {fx('CASE WHEN shape > 0 THEN exp(((1+4*shape)*(1+4*shape)-1)/exp(1::DOUBLE)) ELSE alpha END')} AS opacity FROM c""")
def opacity_roundtrip(spark, sf_dir):
    alpha, shape = codecs.encode_opacity(F.col("opacity"))
    rows = splats(spark, sf_dir).select("id", alpha.alias("alpha"), shape.alias("shape"))
    return rows.select("id", fixed(F.col("alpha")).alias("alpha"), fixed(F.col("shape")).alias("shape"), fixed(codecs.decode_opacity(F.col("alpha"), F.col("shape"))).alias("opacity"))


def _field(c):
    return f"(CAST(floor(abs({c})*511*sqrt(2::DOUBLE)+0.5::DOUBLE) AS BIGINT) * CASE WHEN {c} < 0 THEN -1 ELSE 1 END) & 1023"


@query(S + f""", u AS (SELECT id, qx, qy, qz, qw, CASE WHEN abs(qx) >= greatest(abs(qy),abs(qz),abs(qw)) THEN 0 WHEN abs(qy) >= greatest(abs(qz),abs(qw)) THEN 1 WHEN abs(qz) >= abs(qw) THEN 2 ELSE 3 END AS o FROM s)
SELECT id, CASE o WHEN 0 THEN 0 + ({_field('qy')}) + (({_field('qz')}) << 10) + (({_field('qw')}) << 20) WHEN 1 THEN 1073741824 + ({_field('qx')}) + (({_field('qz')}) << 10) + (({_field('qw')}) << 20)
WHEN 2 THEN 2147483648 + ({_field('qx')}) + (({_field('qy')}) << 10) + (({_field('qw')}) << 20) ELSE 3221225472 + ({_field('qx')}) + (({_field('qy')}) << 10) + (({_field('qz')}) << 20) END AS word,
{fx('round(abs(qx), 2)', 2)} AS ax, {fx('round(abs(qw), 2)', 2)} AS aw FROM u""")
def quat_pack(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", codecs.encode_quaternion(ROTATION).alias("word"))
    q = codecs.decode_quaternion(F.col("word"))
    return rows.select("id", "word", fixed(F.round(F.abs(q[0]), 2), 2).alias("ax"), fixed(F.round(F.abs(q[3]), 2), 2).alias("aw"))


@query(S + f""", t AS (SELECT *, greatest(r,g,b) AS m FROM s), e AS (SELECT *, CASE WHEN m > 0 THEN greatest(0, least(31, CAST(ceil(log2(m)) AS BIGINT) + 15)) ELSE 0 END AS base FROM t)
SELECT id, base, {', '.join(f"least(255, CAST(floor({c} / (pow(2::DOUBLE, base-15)/255) + 0.5::DOUBLE) AS BIGINT)) AS m{c}" for c in 'rgb')} FROM e""")
def sh_word(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", codecs.encode_sh(COLOUR).alias("word"))
    return rows.select("id", codecs.bits(F.col("word"), 27, 31).alias("base"), *(codecs.bits(F.col("word"), 8 * i, 255).alias(f"m{c}") for i, c in enumerate("rgb")))


@query(S + f""", t AS (SELECT id, sign(x)*ln(1+abs(x)) AS l FROM s), r AS (SELECT min(l) AS lo, max(l) AS hi FROM t),
c AS (SELECT id, lo, hi, CAST(floor((l-lo)/(hi-lo)*65535+0.5::DOUBLE) AS BIGINT) AS code FROM t, r), v AS (SELECT id, code, lo+(hi-lo)*(code/65535::DOUBLE) AS v FROM c)
SELECT id, code, {fx('sign(v)*(exp(abs(v))-1)', 5)} AS x FROM v""")
def log_position(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", codecs.encode_log_position(F.col("x")).alias("l"))
    ends = rows.agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    code = codecs.half_up((F.col("l") - F.col("lo")) / (F.col("hi") - F.col("lo")) * lit(65535)).alias("code")
    return rows.select("id", code, "lo", "hi").select("id", "code", fixed(codecs.decode_log_position(F.col("code"), F.col("lo"), F.col("hi")), 5).alias("x"))


#: Terms of the partial sums below; what follows them is between two integrals, whose mean is off by less than 1e-10.
_TERMS = 2000


def _halved(p: str, mass: str) -> str:
    """SQL of whether the kernel of a power holds less than the mass: the sum of 1/k - 1/(k+p), its tail by an integral."""
    return f"list_sum(list_transform(range(1, {_TERMS}), lambda k: {p}/(k*(k+{p})))) + ln(1 + {p}/({_TERMS} - 0.5::DOUBLE)) < {mass}"


@query("WITH RECURSIVE s AS (" + S.removeprefix("WITH s AS (") + f""", m AS (SELECT DISTINCT opacity*3 AS mass FROM s),
b(mass, low, high, step) AS (SELECT mass, 0::DOUBLE, exp(mass), 0 FROM m WHERE mass > 1
UNION ALL SELECT mass, CASE WHEN {_halved('(low+high)/2', 'mass')} THEN (low+high)/2 ELSE low END, CASE WHEN {_halved('(low+high)/2', 'mass')} THEN high ELSE (low+high)/2 END, step + 1 FROM b WHERE step < 48)
SELECT id, {fx('coalesce((low+high)/2, opacity*3)', 5)} AS opacity FROM s LEFT JOIN b ON b.mass = s.opacity*3 AND step = 48""")
def mass_to_opacity(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", (F.col("opacity") * lit(3)).alias("mass"))
    return rows.select("id", fixed(codecs.mass_to_opacity(F.col("mass")), 5).alias("opacity"))


def _cov(i, j):
    """SQL of an entry of R diag(s²) Rᵀ."""
    turned = lambda k, to: _rotated(Q, ["1" if n == k else "0" for n in range(3)], to)
    return "+".join(f"{turned(k, i)}*{turned(k, j)}*{s}*{s}" for k, s in enumerate(("sx", "sy", "sz")))


COV = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


@query(S + f" SELECT id, {', '.join(f'{fx(_cov(i, j))} AS {n}' for n, (i, j) in zip(COV, PAIRS))}, {fx('sx*sx*sy*sy*sz*sz')} AS det FROM s")
def covariance(spark, sf_dir):
    c = G.covariance(SCALE, ROTATION)
    return splats(spark, sf_dir).select("id", *(fixed(v).alias(n) for n, v in zip(COV, c)), fixed(G.determinant(c)).alias("det"))


AREA = "4*pi()*pow((pow(sx*sy,1.6075::DOUBLE)+pow(sx*sz,1.6075::DOUBLE)+pow(sy*sz,1.6075::DOUBLE))/3, 1/1.6075::DOUBLE)"
WIDER = "CASE WHEN opacity > 1 THEN sqrt(1+exp(1::DOUBLE)*ln(opacity)) ELSE 1 END"
POWER = f"exp(((1+4*({SHAPE}))*(1+4*({SHAPE}))-1)/exp(1::DOUBLE))"


def _iso(cut):
    rel = f"{cut}::DOUBLE/least(opacity, 1.0::DOUBLE)"
    return f"sqrt(-2*ln(CASE WHEN opacity > 1 THEN 1-pow(1-{cut}::DOUBLE, 1/{POWER}) ELSE {rel} END))"


@query(S + f" SELECT id, {fx(AREA)} AS area, {fx(f'2*greatest(sx,sy,sz)*{WIDER}')} AS feature, {fx(_iso(0.01))} AS iso FROM s")
def sizes(spark, sf_dir):
    o = F.col("opacity")
    return splats(spark, sf_dir).select("id", fixed(G.surface(SCALE)).alias("area"), fixed(G.feature_size(SCALE, o)).alias("feature"), fixed(G.iso_radius(o, 0.01)).alias("iso"))


MATRIX = [[0.5, -0.25, 0.0, 3.0], [0.0, 1.0, 2.0, -1.5], [1.0, 0.0, 0.25, 0.0]]


@query(S + " SELECT id, " + ", ".join(fx("+".join(f"{c}::DOUBLE*{a}" for c, a in zip(row, P)) + f"+{row[3]}::DOUBLE") + f" AS {a}" for a, row in zip(P, MATRIX)) + " FROM s")
def affine(spark, sf_dir):
    return splats(spark, sf_dir).select("id", *(fixed(c).alias(a) for a, c in zip(P, G.affine(MATRIX, POSITION))))


def _sh_sql(k):
    """SQL of the basis functions of degrees 1 to 3, in the direction (x, y, z) of unit length."""
    return [
        "-0.4886025::DOUBLE*y", "0.4886025::DOUBLE*z", "-0.4886025::DOUBLE*x", "1.0925484::DOUBLE*x*y", "-1.0925484::DOUBLE*y*z", "0.3153915::DOUBLE*(2*z*z-x*x-y*y)",
        "-1.0925484::DOUBLE*x*z", "0.5462742::DOUBLE*(x*x-y*y)", "-0.5900436::DOUBLE*y*(3*x*x-y*y)", "2.8906114::DOUBLE*x*y*z", "-0.4570458::DOUBLE*y*(4*z*z-x*x-y*y)",
        "0.3731763::DOUBLE*z*(2*z*z-3*x*x-3*y*y)", "-0.4570458::DOUBLE*x*(4*z*z-x*x-y*y)", "1.4453057::DOUBLE*z*(x*x-y*y)", "-0.5900436::DOUBLE*x*(x*x-3*y*y)",
    ][k]


@query(f"""WITH d AS (SELECT vec_id, embedding AS c, (vec_id%7)-3.25::DOUBLE AS a, (vec_id%5)-2.25::DOUBLE AS b, (vec_id%3)-1.25::DOUBLE AS e FROM embeddings),
n AS (SELECT vec_id, c, a/sqrt(a*a+b*b+e*e) AS x, b/sqrt(a*a+b*b+e*e) AS y, e/sqrt(a*a+b*b+e*e) AS z FROM d)
SELECT vec_id, {', '.join(fx('+'.join(f'({_sh_sql(k)})*CAST(c[{3 * k + i + 1}] AS DOUBLE)' for k in range(15))) + f' AS {n}' for i, n in enumerate('rgb'))} FROM n""")
def sh_eval(spark, sf_dir):
    from ..operators.rendering import view_colour

    d = [(F.col("vec_id") % m).cast("double") - lit(o) for m, o in ((7, 3.25), (5, 2.25), (3, 1.25))]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("c"), *(c.alias(a) for a, c in zip(P, V.normalize(d))))
    return rows.select("vec_id", *(fixed(c).alias(n) for n, c in zip("rgb", view_colour(POSITION, F.col("c"), 3))))


@query(S + f", t AS (SELECT id, opacity*5 AS v FROM s) SELECT id, v >= 2 AND v <= 5 AS inside, NOT (v >= 2 AND v <= 5) AS outside, v >= 4 AS above, false AS never FROM t")
def blind_range(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", (F.col("opacity") * lit(5)).alias("v"))
    v = F.col("v")
    tests = {"inside": filters.in_range(v, 2, 5), "outside": filters.in_range(v, 2, 5, True), "above": filters.in_range(v, 4), "never": filters.in_range(v, 5, 2)}
    return rows.select("id", *(t.alias(k) for k, t in tests.items()))


@query(S + """, a AS (SELECT id, CAST(id AS HUGEINT) AS h FROM s), b AS (SELECT id, CAST((CAST(xor(CAST(h AS BIGINT), CAST(h AS BIGINT) >> 16) AS HUGEINT) * 2146121005) % 4294967296 AS BIGINT) AS h FROM a),
c AS (SELECT id, CAST((CAST(xor(h, h >> 15) AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT) AS h FROM b) SELECT id, xor(h, h >> 16) AS h FROM c""")
def hash_u32(spark, sf_dir):
    return splats(spark, sf_dir).select("id", N.hash32(F.col("id")).alias("h"))


@query(S + " SELECT id, x FROM s WHERE id >= 100 AND id < 1100")
def range_extract(spark, sf_dir):
    return splats(spark, sf_dir).where(filters.in_file_range(100, 1000)).select("id", "x")


@query(S + f" SELECT id, CAST(floor(greatest(0, least(1, (x+62.5::DOUBLE)/125))*65535+0.5::DOUBLE) AS BIGINT) AS code, {fx('-62.5::DOUBLE+125*(CAST(floor(greatest(0, least(1, (x+62.5::DOUBLE)/125))*65535+0.5::DOUBLE) AS BIGINT)/65535::DOUBLE)')} AS value FROM s")
def blind_codes(spark, sf_dir):
    rows = splats(spark, sf_dir).select("id", codecs.blind_code(F.col("x"), "unorm16", -62.5, 62.5).alias("code"))
    return rows.select("id", "code", fixed(codecs.blind_value(F.col("code"), "unorm16", -62.5, 62.5)).alias("value"))
