"""Scalar functions on columns: parsing, conversion and small models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "XYZEFIJRST"


def finite_or_null(x: Column) -> Column:
    """Null for NaN and infinities, so that aggregates skip them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def filament_area(diameter: Column) -> Column:
    return F.pi() * (diameter / 2) ** 2


def feed_of_flow(flow: Column, diameter: Column) -> Column:
    """Filament speed for a volume per second."""
    return F.try_divide(flow, filament_area(diameter))


def flow_duration(volume: Column, flow: Column) -> Column:
    return F.try_divide(volume, flow)


def per_minute(feed: Column) -> Column:
    return feed * 60


def filament_length(feed: Column, duration: Column) -> Column:
    """What a feed extrudes in a time."""
    return feed * duration


def grid(lo: Column, hi: Column, step: Column, digits: int = 4) -> Column:
    """An array from lo by step to about hi: as many steps as round(), ties to even, gives; one value if there is no room."""
    n = F.bround(F.try_divide(hi - lo, step), 0).cast("int")
    many = F.transform(F.sequence(F.lit(0), n), lambda i: F.bround(lo + i * step, digits))
    return F.when((step <= 0) | (hi <= lo), F.array(F.bround(lo, digits))).otherwise(many)


def move_time(distance: Column, speed: Column, accel: Column | None = None) -> Column:
    """Seconds of a move that speeds up and slows down at a constant rate (2000 mm/s² if none is known)."""
    a = F.coalesce(F.when(accel > 0, accel), F.lit(2000.0)) if accel is not None else F.lit(2000.0)
    ramp = speed * speed / (2 * a)
    cruise = 2 * speed / a + (distance - 2 * ramp) / speed
    return F.when((distance <= 1e-9) | (speed <= 1e-9), 0.0).when(2 * ramp <= distance, cruise).otherwise(2 * F.sqrt(distance / a))


def power_law(a: Column, b: Column, c: Column, q: Column) -> Column:
    return a * F.pow(q, b) + c


def square_wave(t: Column, start: Column, period: Column, slow_half: Column, fast_half: Column, slow: Column, fast: Column, accel: Column) -> Column:
    """Commanded speed at t: slow legs then fast ones from `start`, with ramps limited by the acceleration and by half
    of each leg; slow before the start."""
    phase = F.pmod(t - start, period)
    ramp = F.least(F.abs(fast - slow) / accel, slow_half / 2, fast_half / 2)
    rising = slow + (fast - slow) * F.try_divide(phase - slow_half, ramp)
    falling = fast + (slow - fast) * F.try_divide(phase, ramp)
    inside = F.when(phase < slow_half, F.when(phase < ramp, falling).otherwise(slow)).otherwise(F.when(phase < slow_half + ramp, rising).otherwise(fast))
    first = (t - start < ramp) & (t >= start)
    return F.when((t < start) | first, slow).otherwise(inside)


def axis_value(line: Column, axis: str) -> Column:
    """The number after an axis letter in a program line, comments left out; null if there is none or it is malformed."""
    if axis not in AXES:
        raise ValueError(f"no axis {axis}")
    code = F.regexp_replace(line, r";.*$", "")
    return F.nullif(F.regexp_extract(code, rf"(?i)(?:^|\s){axis}([-+]?\d*\.?\d+)(?=\s|$)", 1), F.lit("")).cast("double")


def extrusion(line: Column) -> Column:
    """struct(e, f) of a G1 line; null for another line."""
    is_g1 = line.rlike(r"(?i)^\s*G1(\s|$)")
    return F.when(is_g1, F.struct(axis_value(line, "E").alias("e"), axis_value(line, "F").alias("f")))


def comment_feature(line: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(line, r"^\s*;TYPE:(.+)$", 1)), F.lit(""))


def comment_z(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^\s*;Z:\s*([-+]?\d*\.?\d+)", 1), F.lit("")).cast("double")


#: Printer models by the spellings in use, and the tools of the model that changes them: fixed values.
MODEL_ALIASES = {"COREONE": "COREONE", "CORE1": "COREONE", "COREONEINDX": "COREONEINDX", "CORE1INDX": "COREONEINDX", "INDX": "COREONEINDX"}
TOOLS = {"COREONEINDX": (0, 7)}


def printer_model(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """The canonical model of a spelling, case, spaces and underscores ignored; COREONE for none, an error for an unknown one."""
    aliases = aliases or MODEL_ALIASES
    plain = F.regexp_replace(F.upper(value), r"[ _]|^\s+|\s+$", "")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    found = F.try_element_at(known, plain)
    return F.when(value.isNull() | (value == ""), F.lit("COREONE")).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown printer model: "), value)).cast("string"))


def tool_index(model: Column, tool: Column) -> Column:
    """The tool as it is; an error for a null one, or one that the (canonical) model hasn't got."""
    odd = tool.isNull()
    for name, (lo, hi) in TOOLS.items():
        odd = odd | ((model == name) & ~tool.between(lo, hi))
    return F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.concat(F.lit("no such tool: "), F.coalesce(tool.cast("string"), F.lit("null")))).cast("int")).otherwise(tool.cast("int"))


def is_run_file(name: Column, prefix: str) -> Column:
    """Whether a file name is one of a kind's saved runs: no path in it, the kind's prefix and the suffix .npz."""
    return name.rlike(rf"^{prefix}_[A-Za-z0-9_.-]+\.npz$") & ~name.contains("..")


def weights(text: Column, known: list[str]) -> Column:
    """A map of name=value pairs; an unknown name is an error."""
    pairs = F.transform_values(F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("=")), lambda _, v: v.cast("double"))
    odd = F.array_except(F.map_keys(pairs), F.array(*[F.lit(k) for k in known]))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown weight: "), F.array_join(odd, ", "))).cast("map<string,double>")).otherwise(pairs)


def circle(x0: Column, y0: Column, x1: Column, y1: Column, i: Column, j: Column, clockwise: Column) -> Column:
    """struct(cx, cy, r, a, sweep) of an arc around (x0 + i, y0 + j), sweep signed; null where start and end differ in
    radius by more than 0.05 mm or 1 %, or where there is no way from one to the other."""
    ends = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (x0 + i).alias("cx"), (y0 + j).alias("cy"), F.hypot(i, j).alias("r0"), F.coalesce(clockwise, F.lit(False)).alias("cw"))
    turn = 2 * F.pi()

    # each step is bound once, as later ones use it several times
    def angles(e: Column) -> Column:
        a0, a1 = F.atan2(e["y0"] - e["cy"], e["x0"] - e["cx"]), F.atan2(e["y1"] - e["cy"], e["x1"] - e["cx"])
        way = F.pmod(F.when(e["cw"], a0 - a1).otherwise(a1 - a0), turn)
        back = F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]) <= 1e-9
        return F.struct(e["cx"].alias("cx"), e["cy"].alias("cy"), e["r0"].alias("r0"), F.hypot(e["x1"] - e["cx"], e["y1"] - e["cy"]).alias("r1"), a0.alias("a"), e["cw"].alias("cw"), way.alias("way"), back.alias("back"))

    def found(g: Column) -> Column:
        way = F.when((g["way"] <= 1e-12) & g["back"], turn).otherwise(g["way"])
        fits = (g["r0"] > 1e-9) & (F.abs(g["r0"] - g["r1"]) <= F.greatest(F.lit(0.05), 0.01 * F.greatest(g["r0"], g["r1"]))) & (way > 1e-12)
        return F.when(fits, F.struct(g["cx"].alias("cx"), g["cy"].alias("cy"), ((g["r0"] + g["r1"]) / 2).alias("r"), g["a"].alias("a"), (F.when(g["cw"], -way).otherwise(way)).alias("sweep")))

    return F.transform(F.transform(F.array(ends), angles), found)[0]


def arc_length(c: Column) -> Column:
    """The way along an arc that circle() gives."""
    return c["r"] * F.abs(c["sweep"])


def points_on(c: Column, x1: Column, y1: Column, step: float = 0.5, degrees: float = 10.0) -> Column:
    """The points of an arc that circle() gives, at most `step` and `degrees` apart, its exact end last."""

    def pieces(c: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(arc_length(c) / step), F.ceil(F.abs(c["sweep"]) / F.radians(F.lit(degrees)))).cast("int")

    # bound once, so that points don't work the circle out anew
    bound = F.transform(F.array(c), lambda c: F.when(c.isNotNull(), F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), c["r"].alias("r"), c["a"].alias("a"), (c["sweep"] / pieces(c)).alias("step"), pieces(c).alias("n"))))

    def points(c: Column) -> Column:
        last = lambda k: k == c["n"]
        angle = lambda k: c["a"] + c["step"] * k
        return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(1), c["n"]), lambda k: F.struct(F.when(last(k), x1).otherwise(c["cx"] + c["r"] * F.cos(angle(k))).alias("x"), F.when(last(k), y1).otherwise(c["cy"] + c["r"] * F.sin(angle(k))).alias("y"))))

    return F.transform(bound, points)[0]


def arc_points(x0: Column, y0: Column, x1: Column, y1: Column, i: Column, j: Column, clockwise: Column, step: float = 0.5, degrees: float = 10.0) -> Column:
    """points_on(circle()): null where start and end differ in radius by more than 0.05 mm or 1 %."""
    return points_on(circle(x0, y0, x1, y1, i, j, clockwise), x1, y1, step, degrees)


def first_of(fields: Column, *keys: str) -> Column:
    """The number in the first of these keys that holds one (booleans and texts don't): null if it isn't finite."""
    number = [F.coalesce(F.try_element_at(fields, F.lit(k))["d"], F.try_element_at(fields, F.lit(k))["l"].cast("double")) for k in keys]
    chosen = reduce(lambda rest, x: F.when(x.isNotNull(), x).otherwise(rest), reversed(number), F.lit(None).cast("double"))
    return finite_or_null(chosen)


def first_finite(fields: Column) -> Column:
    """The first finite number of a field map, in the order of the line."""
    numbers = F.transform(F.map_values(fields), lambda v: F.coalesce(v["d"], v["l"].cast("double")))
    return F.try_element_at(F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(1))


def numeric(fields: Column) -> Column:
    """`v` if it is a finite number, else the first finite one."""
    return F.coalesce(first_of(fields, "v"), first_finite(fields))


def force(fields: Column) -> Column:
    """The first of load, force, z, v that holds a number, null if that isn't finite; without any, the first finite one."""
    keys = ("load", "force", "z", "v")
    held = reduce(lambda a, b: a | b, [F.coalesce(F.try_element_at(fields, F.lit(k))["d"].isNotNull() | F.try_element_at(fields, F.lit(k))["l"].isNotNull(), F.lit(False)) for k in keys])
    return F.when(held, first_of(fields, *keys)).otherwise(first_finite(fields))
