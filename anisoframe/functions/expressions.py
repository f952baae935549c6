"""A typed expression language for rows of Gaussians, compiled to columns.

``define`` calls a builder once with the row's fields, the operations and bindings of outside attributes, and checks all
types then. ``Program.apply`` adds the patch to a DataFrame: rows for which ``when`` does not hold keep their values.
Nothing runs in Python per row; Catalyst folds, shares and prunes the columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S
from . import vectors as V

SIZES = {"float": 1, "bool": 1, "vec2": 2, "vec3": 3, "vec4": 4, "quaternion": 4}
#: Operations that one program may have.
MOST = 4096
FIELDS = {"position": ("vec3", "x y z"), "scale": ("vec3", "sx sy sz"), "quaternion": ("quaternion", "qx qy qz qw"), "opacity": ("float", "opacity")}
#: Largest opacity that the wide kernel can draw: exp(24 / e).
MAX_OPACITY = 6830.1820


@dataclass(frozen=True)
class Value:
    """A typed value: one column for each component."""

    kind: str
    parts: tuple[Column, ...]


class Operations:
    """The operations of the language; every one checks the types it is given."""

    def __init__(self):
        self.count = 0

    def _made(self, kind: str, parts) -> Value:
        self.count += 1
        if self.count > MOST:
            raise ValueError(f"a program has at most {MOST} operations")
        return Value(kind, tuple(parts))

    @staticmethod
    def value(x) -> Value:
        if isinstance(x, Value):
            return x
        if isinstance(x, bool):
            return Value("bool", (F.lit(x),))
        if isinstance(x, (int, float)):
            if not abs(x) < S.INF:
                raise ValueError("constants must be finite")
            return Value("float", (S.lit(x),))
        if isinstance(x, (tuple, list)) and 2 <= len(x) <= 4:
            return Value(f"vec{len(x)}", tuple(S.lit(v) for v in x))
        raise TypeError(f"no value of the language: {x!r}")

    def _numbers(self, *xs) -> tuple[str, list[tuple[Column, ...]]]:
        """Values of one type; floats are used for every component."""
        values = [self.value(x) for x in xs]
        kind = values[0].kind
        if kind in ("bool", "quaternion") and any(v.kind == "bool" for v in values):
            raise TypeError("numbers are asked for")
        for v in values[1:]:
            if v.kind not in (kind, "float"):
                raise TypeError(f"{v.kind} where {kind} is asked for")
        n = SIZES[kind]
        return kind, [v.parts if len(v.parts) == n else v.parts * n for v in values]

    def _each(self, f: Callable, *xs) -> Value:
        kind, parts = self._numbers(*xs)
        return self._made(kind, (f(*p) for p in zip(*parts)))

    def _bools(self, *xs) -> list[Column]:
        values = [self.value(x) for x in xs]
        if any(v.kind != "bool" for v in values):
            raise TypeError("booleans are asked for")
        return [v.parts[0] for v in values]

    def _floats(self, *xs) -> list[Column]:
        values = [self.value(x) for x in xs]
        if any(v.kind != "float" for v in values):
            raise TypeError("single numbers are asked for")
        return [v.parts[0] for v in values]

    def _vectors(self, *xs, kinds=("vec2", "vec3", "vec4")) -> list[tuple[Column, ...]]:
        values = [self.value(x) for x in xs]
        if values[0].kind not in kinds or len({v.kind for v in values}) > 1:
            raise TypeError(f"{', '.join(kinds)} of one size are asked for")
        return [v.parts for v in values]

    def add(self, first, *rest):
        return reduce(lambda a, b: self._each(lambda x, y: x + y, a, b), rest, self.value(first))

    def mul(self, first, *rest):
        return reduce(lambda a, b: self._each(lambda x, y: x * y, a, b), rest, self.value(first))

    def sub(self, a, b):
        return self._each(lambda x, y: x - y, a, b)

    def div(self, a, b):
        return self._each(S.quotient, a, b)

    def min(self, a, b):
        return self._each(S.minimum, a, b)

    def max(self, a, b):
        return self._each(S.maximum, a, b)

    def pow(self, a, b):
        return self._each(F.pow, a, b)

    def atan2(self, a, b):
        return self._each(F.atan2, a, b)

    def clamp(self, x, low, high):
        return self._each(S.clamp, x, low, high)

    def mix(self, a, b, t):
        return self._each(S.mix, a, b, t)

    def muladd(self, a, b, c):
        """a * b + c in two roundings."""
        return self.add(self.mul(a, b), c)

    def addmul(self, a, b, c):
        """(a + b) * c in two roundings."""
        return self.mul(self.add(a, b), c)

    def normalize(self, v):
        (parts,) = self._vectors(v, kinds=("vec2", "vec3", "vec4", "quaternion"))
        return self._made(self.value(v).kind, V.normalize(parts))

    def length(self, v):
        return self._made("float", [V.length(self._vectors(v)[0])])

    def isFinite(self, v):  # noqa: N802 - the language's own name
        return self._made("bool", [reduce(lambda a, b: a & b, map(S.is_finite, self.value(v).parts))])

    def eq(self, a, b):
        a, b = self.value(a), self.value(b)
        if a.kind != b.kind:
            raise TypeError(f"{a.kind} is never equal to {b.kind}")
        same = (lambda x, y: x == y) if a.kind == "bool" else S.equal
        return self._made("bool", [reduce(lambda p, q: p & q, map(same, a.parts, b.parts))])

    def ne(self, a, b):
        return self.not_(self.eq(a, b))

    def lt(self, a, b):
        return self._made("bool", [S.less(*self._floats(a, b))])

    def lte(self, a, b):
        return self._made("bool", [S.less_equal(*self._floats(a, b))])

    def gt(self, a, b):
        return self.lt(b, a)

    def gte(self, a, b):
        return self.lte(b, a)

    def and_(self, first, *rest):
        return self._made("bool", [reduce(lambda a, b: a & b, self._bools(first, *rest))])

    def or_(self, first, *rest):
        return self._made("bool", [reduce(lambda a, b: a | b, self._bools(first, *rest))])

    def not_(self, a):
        return self._made("bool", [~self._bools(a)[0]])

    def select(self, condition, yes, no):
        (test,), yes, no = self._bools(condition), self.value(yes), self.value(no)
        if yes.kind != no.kind:
            raise TypeError(f"{yes.kind} or {no.kind}?")
        return self._made(yes.kind, (F.when(test, a).otherwise(b) for a, b in zip(yes.parts, no.parts)))

    def dot(self, a, b):
        return self._made("float", [V.dot(*self._vectors(a, b))])

    def cross(self, a, b):
        return self._made("vec3", V.cross(*self._vectors(a, b, kinds=("vec3",))))

    def vec2(self, x, y):
        return self._made("vec2", self._floats(x, y))

    def vec3(self, x, y, z):
        return self._made("vec3", self._floats(x, y, z))

    def vec4(self, x, y, z, w):
        return self._made("vec4", self._floats(x, y, z, w))

    def quaternion(self, x, y, z, w):
        return self._made("quaternion", self._floats(x, y, z, w))

    def component(self, v, index: int):
        (parts,) = self._vectors(v, kinds=("vec2", "vec3", "vec4", "quaternion"))
        return self._made("float", [parts[index]])

    def maxComponentIndex(self, v):  # noqa: N802 - the language's own name
        return self._made("float", [V.largest_component(self._vectors(v)[0]).cast("double")])

    def quatMul(self, a, b):  # noqa: N802 - the language's own name
        return self._made("quaternion", V.quaternion_product(*self._vectors(a, b, kinds=("quaternion",))))

    def rotateVector(self, q, v):  # noqa: N802 - the language's own name
        (q,), (v,) = self._vectors(q, kinds=("quaternion",)), self._vectors(v, kinds=("vec3",))
        return self._made("vec3", V.rotate(q, v))


def _unary(f: Callable[[Column], Column]) -> Callable:
    return lambda self, x: self._each(f, x)


for _name, _f in {
    "neg": lambda x: -x, "abs": F.abs, "sqrt": F.sqrt, "log": S.log, "exp": F.exp, "floor": S.floor, "ceil": S.ceil, "round": S.round_away,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
}.items():
    setattr(Operations, _name, _unary(_f))

# What stored numbers of each attribute format stand for.
FORMATS = {
    "f32": lambda x: x, "f16": lambda x: x, "u8": lambda x: x, "i8": lambda x: x, "u16": lambda x: x, "i16": lambda x: x, "u32": lambda x: x,
    "i32": lambda x: x, "unorm8": lambda x: x / S.lit(255), "unorm16": lambda x: x / S.lit(65535),
    "snorm8": lambda x: F.greatest(x / S.lit(127), S.lit(-1)), "snorm16": lambda x: F.greatest(x / S.lit(32767), S.lit(-1)),
}


@dataclass(frozen=True)
class Attribute:
    """Columns of another table, joined by row id; rows that it lacks are not patched."""

    table: DataFrame
    columns: tuple[str, ...]
    key: str


class Fields:
    """The row's own values."""

    def __init__(self):
        for name, (kind, columns) in FIELDS.items():
            setattr(self, name, Value(kind, tuple(V.columns(columns))))


class Program:
    def __init__(self, patch: dict, attributes: list[Attribute]):
        unknown = set(patch) - {"when", *FIELDS}
        if unknown:
            raise ValueError(f"no output of a program: {', '.join(sorted(unknown))}")
        self.patch = {k: Operations.value(v) for k, v in patch.items()}
        for name, v in self.patch.items():
            want = "bool" if name == "when" else FIELDS[name][0]
            if v.kind != want and not (want == "quaternion" and v.kind == "vec4"):
                raise TypeError(f"{name} is a {want}, not a {v.kind}")
        self.attributes = attributes

    def apply(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """``rows`` with the patch. Quaternions become unit (zero and infinite ones stay as given), opacity is kept in range."""
        names, test = rows.columns, F.lit(True)
        for i, a in enumerate(self.attributes):
            there = f"__there{i}"
            own = a.table.select(F.col(a.key).alias(f"__key{i}"), F.lit(True).alias(there), *(F.col(c).alias(f"__a{i}_{k}") for k, c in enumerate(a.columns)))
            rows = rows.join(own, rows[key] == own[f"__key{i}"], "left")
            test = test & F.coalesce(there, F.lit(False))
        if "when" in self.patch:
            test = test & self.patch["when"].parts[0]
        new = {}
        for name, value in self.patch.items():
            if name == "when":
                continue
            parts = value.parts
            if name == "quaternion":
                parts = V.normalize(parts)
            if name == "opacity":
                parts = [S.clamp(parts[0], S.lit(0), S.lit(MAX_OPACITY))]
            new.update({c: F.when(test, p).otherwise(F.col(c)) for c, p in zip(FIELDS[name][1].split(), parts)})
        return rows.withColumns(new).select(*names)


def define(build: Callable[[Fields, Operations, Callable], dict]) -> Program:
    """A program from ``build(splat, op, attribute)``, which returns the patch."""
    attributes: list[Attribute] = []

    def attribute(table: DataFrame, columns: str | list[str], key: str = "id", format: str = "f32") -> Value:
        columns = [columns] if isinstance(columns, str) else list(columns)
        if not 1 <= len(columns) <= 4:
            raise ValueError("an attribute has one to four components")
        attributes.append(Attribute(table, tuple(columns), key))
        i = len(attributes) - 1
        parts = tuple(FORMATS[format](F.col(f"__a{i}_{k}").cast("double")) for k in range(len(columns)))
        return Value("float" if len(parts) == 1 else f"vec{len(parts)}", parts)

    return Program(build(Fields(), Operations(), attribute), attributes)
