"""Programs as tables of moves.

What a line of a program means depends on the lines before it: modes, feed,
acceleration, position, feature and layer.  Each of these is a segmented scan
over a program's lines: a mode is the last word that set it, a position is the
sum of the relative words since the word that set it last, and a layer's
number counts the moves that open one.

files: run_id, text.  moves: see MOVES; layers: run_id, layer, z, move_lo,
move_hi (half open).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import scalar

MOVES = "run_id string, move_idx int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, e double, feed_mm_s double, feature string, layer int, extruding boolean, length_mm double, t_start double, t_end double, layer_z double, first boolean, line int"
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
#: Rise of an extruding move, in mm, that opens a layer where a program has no layer marks.
RISE = 0.02


def words(files: DataFrame) -> DataFrame:
    """One row for each line of a program that can matter, with its parts.

    run_id, file (one number for each row of files), line (from 0), marked
    (whether the program marks its layers), code (in upper case; null for a
    comment), the words X Y Z E F I J P S T (the last one of a letter that is
    a number), feature, mark and note_z of comments.
    """
    binary = F.col("text").startswith("GCDE")
    text = F.when(binary, F.raise_error(F.concat(F.lit("a binary program: "), F.col("run_id"))).cast("string")).otherwise(F.col("text"))
    marked = F.upper("text").contains(";LAYER_CHANGE")
    numbered = files.select("run_id", F.monotonically_increasing_id().alias("file"), marked.alias("marked"), text.alias("text"))
    lines = numbered.select("run_id", "file", "marked", F.posexplode(F.split("text", _ENDS)).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    note = F.col("raw").startswith(";")
    parts = F.split(F.regexp_replace(F.regexp_replace("raw", ";.*$", ""), r"\s+$", ""), r"\s+")
    pairs = F.transform(F.filter(F.slice(parts, 2, 1 << 20), lambda p: F.substring(p, 2, 1 << 20).rlike(_NUMBER)), lambda p: F.struct(F.upper(F.substring(p, 1, 1)).alias("a"), F.substring(p, 2, 1 << 20).cast("double").alias("v")))
    parsed = lines.withColumns({"code": F.when(~note, F.upper(parts[0])), "_pairs": F.when(~note, pairs)})
    feature = F.nullif(F.regexp_extract("raw", r"(?i)^;\s*TYPE:\s*(.+)$", 1), F.lit(""))
    note_z = F.nullif(F.regexp_extract("raw", r"(?i)^;\s*Z:\s*([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")

    def word(axis: str) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: p["a"] == axis), F.lit(-1))["v"]

    axes = {a: word(a) for a in "XYZEFIJPST"}
    notes = {"feature": F.when(note, feature), "mark": note & F.upper("raw").startswith(";LAYER_CHANGE"), "note_z": F.when(note, note_z)}
    known = F.col("code").isin("G0", "G1", "G2", "G3", "G00", "G01", "G02", "G03", "G17", "G18", "G19", "G90", "G91", "G90.1", "G91.1", "G92", "M82", "M83", "M204")
    return parsed.withColumns(axes | notes).where(known | F.col("feature").isNotNull() | F.col("mark") | F.col("note_z").isNotNull()).drop("raw", "_pairs")


def _placed(df: DataFrame, move: Column, absolute: dict[str, Column]) -> DataFrame:
    """Adds each axis' place before (x0) and after (x1) each line: in each stretch from one word that sets it to the next, the running sum."""
    w = Window.partitionBy("run_id", "file").orderBy("line")
    sets = {a: F.when((F.col("code") == "G92") | move & by, F.col(a)) for a, by in absolute.items()}
    df = df.withColumns({f"_set{a}": c for a, c in sets.items()} | {f"_add{a}": F.coalesce(sets[a], F.when(move & ~by, F.col(a))) for a, by in absolute.items()})
    df = df.withColumns({f"_stretch{a}": F.count(f"_set{a}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for a in absolute})
    for a in absolute:
        along = Window.partitionBy("run_id", "file", f"_stretch{a}").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"{a.lower()}1", F.coalesce(F.sum(f"_add{a}").over(along), F.lit(0.0)))
    df = df.withColumns({f"{a.lower()}0": F.lag(f"{a.lower()}1", 1, 0.0).over(w) for a in absolute})
    return df.drop(*[f"_{x}{a}" for a in absolute for x in ("set", "add", "stretch")])


def commands(files: DataFrame, accel: float = 2000.0) -> DataFrame:
    """One row for each motion command, with all that it depends on.

    run_id, file, line, x0 ... z1, e, feed_mm_s, feature, extruding,
    length_mm (the way in the plane, else the rise, else the filament), t_start, t_end, layer, layer_z,
    points (the ends of its straight pieces).
    """
    w = Window.partitionBy("run_id", "file").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    code = F.col("code")
    move = F.coalesce(code.isin("G0", "G1", "G2", "G3", "G00", "G01", "G02", "G03"), F.lit(False))

    def mode(value: Column, start) -> Column:
        return F.coalesce(F.last(value, ignorenulls=True).over(upto), F.lit(start))

    m204 = code == "M204"
    df = words(files).withColumns(
        {
            "_absolute": mode(F.when(code.isin("G90", "G91"), code == "G90"), True),
            "_e_absolute": mode(F.when(code.isin("M82", "M83"), code == "M82"), True),
            "_flat": mode(F.when(code.isin("G17", "G18", "G19"), code == "G17"), True),
            "_centre": mode(F.when(code.isin("G90.1", "G91.1"), code == "G91.1"), True),
            "_feed": mode(F.when(move, F.col("F")), 1200.0) / 60,
            "_print": mode(F.when(m204, F.coalesce("S", "P")), accel),
            "_travel": mode(F.when(m204, F.coalesce("T", "S")), accel),
            "_type": mode(F.col("feature"), ""),
            "_marks": F.count(F.when(F.col("mark"), 1)).over(upto),
        }
    )
    df = _placed(df, move, dict.fromkeys("XYZ", F.col("_absolute")) | {"E": F.col("_e_absolute")})
    de = F.when(move & F.col("E").isNotNull(), F.when(F.col("_e_absolute"), F.col("E") - F.col("e0")).otherwise(F.col("E"))).otherwise(0.0)
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    i, j = F.coalesce("I", F.lit(0.0)), F.coalesce("J", F.lit(0.0))
    clockwise = code.isin("G2", "G02")
    round_ = code.isin("G2", "G3", "G02", "G03") & F.col("_flat") & F.col("_centre") & (F.col("I").isNotNull() | F.col("J").isNotNull())
    df = df.withColumns({"e": de, "_circle": F.when(round_, scalar.circle(*ends, i, j, clockwise))})
    df = df.withColumn("_way", F.coalesce(scalar.arc_length(F.col("_circle")), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    extruding = move & (F.col("e") > 1e-6) & (F.col("_way") > 1e-9)
    rise = F.abs(F.col("z1") - F.col("z0"))
    length = F.when(F.col("_way") > 1e-9, F.col("_way")).when(rise > 1e-9, rise).otherwise(F.abs("e"))
    df = df.withColumns({"extruding": extruding, "length_mm": length})
    # in programs with marks, the first extruding move after one opens a layer; its height is the last one noted since
    seen = F.coalesce(F.last(F.when(F.col("extruding"), F.col("_marks")), ignorenulls=True).over(before), F.lit(0))
    noted = F.last("note_z", ignorenulls=True).over(Window.partitionBy("run_id", "file", "_marks").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.count(F.when(F.col("extruding"), 1)).over(upto)
    df = df.withColumns({"_opens": F.col("marked") & F.col("extruding") & (F.col("_marks") > seen), "_noted": F.coalesce(noted, F.col("z1")), "_nth": nth})
    # without marks, only moves higher than all before can open one (the first has a rule of its own)
    higher = F.col("z1") > F.coalesce(F.max(F.when(F.col("extruding") & (F.col("_nth") > 1), F.col("z1"))).over(before), F.lit(float("-inf")))
    df = df.withColumn("_may", ~F.col("marked") & F.col("extruding") & ((F.col("_nth") == 1) | higher))
    df = df.join(_risen(df), ["run_id", "file", "line"], "left")
    df = df.withColumn("_z", F.when(F.col("_opens"), F.col("_noted")).otherwise(F.col("_risen_z")))
    seconds = F.when(move, scalar.move_time(F.col("length_mm"), F.col("_feed"), F.when(F.col("extruding"), F.col("_print")).otherwise(F.col("_travel")))).otherwise(0.0)
    df = df.withColumns({"layer": (F.count("_z").over(upto) - 1).cast("int"), "layer_z": F.last("_z", ignorenulls=True).over(upto), "_s": seconds})
    df = df.withColumn("t_end", F.sum("_s").over(upto)).withColumn("t_start", F.coalesce(F.lag("t_end").over(w), F.lit(0.0)))
    chord = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    points = F.coalesce(scalar.points_on(F.col("_circle"), F.col("x1"), F.col("y1")), chord)
    return df.where(move).select("run_id", "file", "line", "x0", "y0", "z0", "x1", "y1", "z1", "e", F.col("_feed").alias("feed_mm_s"), F.col("_type").alias("feature"), "extruding", "length_mm", "t_start", "t_end", "layer", "layer_z", points.alias("points"))


def _risen(df: DataFrame) -> DataFrame:
    """(run_id, file, line, _risen_z): the moves that open layers where nothing marks them.

    The first one opens a layer at the height noted before it, if any; then
    each that lies more than RISE above the last layer.  Which those are is
    settled one after the other, over a program's record heights only.
    """
    may = df.where("_may").groupBy("run_id", "file").agg(F.sort_array(F.collect_list(F.struct("line", "z1", F.when(F.col("_nth") == 1, F.col("_noted")).alias("noted")))).alias("c"))
    none = F.struct(F.lit(None).cast("double").alias("z"), F.expr("cast(array() as array<struct<line:int,z:double>>)").alias("open"))

    def step(acc: Column, c: Column) -> Column:
        z = F.coalesce(c["noted"], c["z1"])
        opens = acc["z"].isNull() | (c["z1"] > acc["z"] + RISE)
        return F.when(opens, F.struct(z.alias("z"), F.array_append(acc["open"], F.struct(c["line"].alias("line"), z.alias("z"))).alias("open"))).otherwise(acc)

    opened = may.select("run_id", "file", F.explode(F.aggregate("c", none, step)["open"]).alias("o"))
    return opened.select("run_id", "file", "o.line", F.col("o.z").alias("_risen_z"))


def moves(files: DataFrame, accel: float = 2000.0) -> DataFrame:
    """All files' moves, in straight pieces: an arc gives several, of which the first is marked.

    Files that are binary (magic GCDE) are an error; null and empty ones give
    no moves; lines that aren't understood are left out.
    """
    c = commands(files, accel)
    n = F.size("points")
    along = Window.partitionBy("run_id", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_base", F.coalesce(F.sum(n).over(along), F.lit(0)))
    pieces = c.select("*", n.alias("_n"), F.posexplode("points").alias("_k", "_p"))
    k, last = F.col("_k"), F.col("_k") + 1 == F.col("_n")
    before = F.when(k > 0, F.col("points")[k - 1])

    def height(part: Column) -> Column:
        return F.col("z0") + (F.col("z1") - F.col("z0")) * part / F.col("_n")

    def moment(part: Column) -> Column:
        return F.col("t_start") + (F.col("t_end") - F.col("t_start")) * part / F.col("_n")

    return pieces.select(
        "run_id", (F.col("_base") + k).cast("int").alias("move_idx"), F.coalesce(before["x"], F.col("x0")).alias("x0"), F.coalesce(before["y"], F.col("y0")).alias("y0"), height(k).alias("z0"),
        F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"), F.when(last, F.col("z1")).otherwise(height(k + 1)).alias("z1"), (F.col("e") / F.col("_n")).alias("e"), "feed_mm_s", "feature", "layer", "extruding",
        (F.col("length_mm") / F.col("_n")).alias("length_mm"), moment(k).alias("t_start"), F.when(last, F.col("t_end")).otherwise(moment(k + 1)).alias("t_end"), F.when(F.col("layer") >= 0, F.col("layer_z")).alias("layer_z"), (k == 0).alias("first"), "line",
    )


def layers(moves: DataFrame) -> DataFrame:
    """(run_id, layer, z, move_lo, move_hi)."""
    return moves.where("layer >= 0").groupBy("run_id", "layer").agg(F.min_by("layer_z", "move_idx").alias("z"), F.min("move_idx").alias("move_lo"), (F.max("move_idx") + 1).alias("move_hi"))


def summary(moves: DataFrame) -> DataFrame:
    """(run_id, x_min, y_min, x_max, y_max, n_extruding, n_layers, seconds): the box of what is printed, or of all moves
    where nothing is; commands count once, however many pieces an arc has."""

    def box(f, a: str, b: str):
        printed = F.col("extruding") & (F.col("layer") >= 0)
        pick = F.least if f is F.min else F.greatest
        return F.coalesce(f(F.when(printed, pick(a, b))), f(pick(a, b)))

    return moves.groupBy("run_id").agg(
        box(F.min, "x0", "x1").alias("x_min"), box(F.min, "y0", "y1").alias("y_min"), box(F.max, "x0", "x1").alias("x_max"), box(F.max, "y0", "y1").alias("y_max"),
        F.count_if(F.col("extruding") & F.col("first")).alias("n_extruding"), F.count_distinct(F.when(F.col("layer") >= 0, F.col("layer"))).alias("n_layers"), F.max("t_end").alias("seconds"),
    )


def polylines(moves: DataFrame) -> DataFrame:
    """(run_id, layer, line, feature, points): extruded paths; a new one at a travel, a change of feature or a jump."""
    w = Window.partitionBy("run_id", "layer").orderBy("move_idx")
    joined = F.lag("extruding").over(w) & (F.lag("feature").over(w) == F.col("feature")) & (F.abs(F.lag("x1").over(w) - F.col("x0")) <= 1e-6) & (F.abs(F.lag("y1").over(w) - F.col("y0")) <= 1e-6)
    marked = moves.where("layer >= 0").withColumn("_new", (F.col("extruding") & ~F.coalesce(joined, F.lit(False))).cast("int"))
    lines = marked.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("extruding")
    pack = F.sort_array(F.collect_list(F.struct("move_idx", "x0", "y0", "x1", "y1")))
    grouped = lines.groupBy("run_id", "layer", "line", "feature").agg(pack.alias("m"))
    first = F.transform(F.slice("m", 1, 1), lambda p: F.struct(p["x0"].alias("x"), p["y0"].alias("y")))
    return grouped.select("run_id", "layer", "line", "feature", F.concat(first, F.transform("m", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y")))).alias("points"))


def travel_threshold(moves: DataFrame) -> DataFrame:
    """(run_id, speed) above which the head only travels."""
    speeds = moves.where("length_mm > 1e-9").groupBy("run_id").agg(F.max(F.when(F.col("extruding"), F.col("feed_mm_s"))).alias("p"), F.max(F.when(~F.col("extruding"), F.col("feed_mm_s"))).alias("q"))
    p = F.coalesce("p", F.lit(100.0))
    q = F.coalesce("q", 2 * p)
    return speeds.select("run_id", F.when(q > 1.1 * p, p + 0.4 * (q - p)).otherwise(1.5 * p).alias("speed"))
