"""Programs made of order lines, one for each customer, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import gcode
from sensorloom.queries.curves import rounded, table


def program_texts(spark, sf_dir):
    """A customer's order lines as a program: of every kind of line, in odd spellings; two customers in three mark layers."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, d, s, p = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_suppkey") % 40, F.col("l_partkey") % 60
    kind = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber") * 5) % 26
    tenths = F.concat(F.floor(p / 10).cast("string"), F.lit("."), (p % 10).cast("string"))

    def line(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    mark = F.when(F.col("o_custkey") % 3 == 0, "; nothing").when(d % 3 == 0, ";LAYER_CHANGE").when(d % 3 == 1, ";layer_change").otherwise("  ;Layer_Change 2")
    text = (
        F.when(kind == 0, mark)
        .when(kind == 1, F.when(d % 2 == 0, line(";Z:", tenths)).otherwise(line("; z: ", tenths, " mm")))
        .when(kind == 2, F.when(d % 2 == 0, ";TYPE:Perimeter").otherwise("; type: Solid infill "))
        .when(kind == 3, F.when(d % 2 == 0, "G92 E0").otherwise(line("G92 X", q, " Z", tenths)))
        .when(kind == 4, F.when(d % 3 == 0, line("M204 P", 500 + q, " S", 700 + s)).when(d % 3 == 1, line("M204 T", 600 + q)).otherwise(line("M204 P", 800 + s)))
        .when(kind == 5, F.when(d % 3 == 0, "G91").otherwise("G90"))
        .when(kind == 6, F.when(d % 2 == 0, "M83").otherwise("m82"))
        .when(kind == 7, line("G1 E-", d, " F2400"))
        .when(kind == 8, line("G1 Z", tenths))
        .when(kind == 9, line("G0\tX", q, "\tY", s, " F9000"))
        .when(kind == 10, F.when(s % 2 == 0, line("G2 I", d + 1, " J1 E.5")).otherwise(line("G03 I", d + 1, " J1 E2")))
        .when(kind == 11, line("G3 X", 2 * (d + 1), " I", d + 1, " E1"))
        .when(kind == 12, F.when(d == 0, "G18").otherwise("G17"))
        .when(kind == 13, F.when(d == 1, "G90.1").otherwise("G91.1"))
        .when(kind == 14, line("G1 F", 600 + 60 * q))
        .when(kind == 15, line("G1 Z", tenths, " E1"))
        .when(kind == 16, "G4 P100")
        .otherwise(line("g1 X", q, ".", d % 10, " Y", s, ".5 E", tenths, " ; X99"))
    )
    rows = lines.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("run_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", text.alias("text")).alias("at"))
    return rows.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda a: a["text"]), "\n").alias("text"))


def program_moves(spark, sf_dir):
    """Each motion command of each program: where it ends, how long it takes, in which layer it lies, and the pieces of its arc."""
    moves = gcode.moves(program_texts(spark, sf_dir))
    last = lambda c: F.max_by(c, "move_idx").alias(c)
    found = moves.groupBy("run_id", "line").agg(
        F.count("*").alias("n"), last("x1"), last("y1"), last("z1"), F.sum("x1").alias("sum_x"), F.sum("y1").alias("sum_y"), F.sum("e").alias("e"), F.sum("length_mm").alias("length"),
        last("t_end"), F.min("t_start").alias("t_start"), last("feed_mm_s"), last("feature"), last("extruding"), last("layer"), last("layer_z"),
    )
    return rounded(found, 4)


QUERIES = {"program_moves": program_moves}

#: The same programs, as words instead of texts, read by a machine that goes from line to line.
ORACLES = {
    "program_moves": """
WITH RECURSIVE li AS (
  SELECT 'c' || o_custkey AS run_id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS k,
    l_quantity::INT AS q, round(l_discount * 100)::INT AS d, l_suppkey % 40 AS s, l_partkey % 60 / 10.0::DOUBLE AS p, (l_partkey * 7 + l_suppkey * 3 + l_linenumber * 5) % 26 AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ws AS (
  SELECT run_id, k, kind, d,
    kind = 0 AND c % 3 <> 0 AS mark, CASE WHEN kind = 1 THEN p END AS nz, CASE WHEN kind = 2 THEN CASE WHEN d % 2 = 0 THEN 'Perimeter' ELSE 'Solid infill' END END AS typ,
    kind IN (7, 8, 9, 10, 11, 14, 15) OR kind > 16 AS moves, kind = 3 AS g92,
    CASE WHEN kind = 3 AND d % 2 = 1 THEN q WHEN kind = 9 THEN q WHEN kind = 11 THEN 2 * (d + 1) WHEN kind > 16 THEN (q * 10 + d % 10) / 10.0::DOUBLE END::DOUBLE AS wx,
    CASE WHEN kind = 9 THEN s WHEN kind > 16 THEN s + 0.5 END::DOUBLE AS wy,
    CASE WHEN kind = 3 AND d % 2 = 1 OR kind IN (8, 15) THEN p END::DOUBLE AS wz,
    CASE WHEN kind = 3 AND d % 2 = 0 THEN 0 WHEN kind = 7 THEN -d WHEN kind = 10 THEN CASE WHEN s % 2 = 0 THEN 0.5 ELSE 2 END WHEN kind IN (11, 15) THEN 1 WHEN kind > 16 THEN p END::DOUBLE AS we,
    CASE WHEN kind = 7 THEN 2400 WHEN kind = 9 THEN 9000 WHEN kind = 14 THEN 600 + 60 * q END::DOUBLE AS wf,
    CASE WHEN kind IN (10, 11) THEN d + 1 END::DOUBLE AS wi, CASE WHEN kind = 10 THEN 1 ELSE 0 END::DOUBLE AS wj, kind = 10 AND s % 2 = 0 AS cw,
    CASE WHEN kind = 4 THEN CASE d % 3 WHEN 0 THEN 700 + s WHEN 2 THEN 800 + s END END::DOUBLE AS ap, CASE WHEN kind = 4 THEN CASE d % 3 WHEN 0 THEN 700 + s WHEN 1 THEN 600 + q END END::DOUBLE AS tr,
    bool_or(kind = 0 AND c % 3 <> 0) OVER (PARTITION BY run_id) AS marked
  FROM li),
m AS (
  SELECT run_id, 0::BIGINT AS k, true AS ab, true AS eab, true AS flat, true AS cen, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS z, 0::DOUBLE AS e, 1200::DOUBLE AS f, '' AS typ, 2000::DOUBLE AS ap, 2000::DOUBLE AS tr,
    NOT any_value(marked) AS waits, NULL::DOUBLE AS nz, -1 AS layer, NULL::DOUBLE AS lz, 0::DOUBLE AS t, false AS moves, false AS ext, 0::DOUBLE AS de, 0::DOUBLE AS len, 0::DOUBLE AS t0, NULL::DOUBLE AS r, 0::DOUBLE AS cx, 0::DOUBLE AS cy, 0::DOUBLE AS a0, NULL::DOUBLE AS sweep
  FROM ws GROUP BY run_id
  UNION ALL
  SELECT run_id, k, ab, eab, flat, cen, nx, ny, nzz, CASE WHEN we IS NULL THEN e WHEN g92 OR eab THEN we ELSE e + we END, f, typ, ap, tr,
    waits AND NOT opens, CASE WHEN opens THEN NULL ELSE nz END, layer + opens::INT, CASE WHEN opens THEN CASE WHEN waits AND nz IS NOT NULL THEN nz ELSE nzz END ELSE lz END,
    t + CASE WHEN NOT moves OR len <= 1e-9 THEN 0 WHEN v * v / acc <= len THEN 2 * v / acc + (len - v * v / acc) / v ELSE 2 * sqrt(len / acc) END, moves, ext, de, len, t, r, cx, cy, a0, sweep
  FROM (SELECT *, ext AND (waits OR NOT marked AND nzz > lz + 0.02) AS opens, f / 60 AS v, CASE WHEN ext THEN ap ELSE tr END AS acc
  FROM (SELECT *, moves AND de > 1e-6 AND way > 1e-9 AS ext, CASE WHEN way > 1e-9 THEN way WHEN abs(nzz - z) > 1e-9 THEN abs(nzz - z) ELSE abs(de) END AS len
  FROM (SELECT *, coalesce(r * abs(sweep), sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS way, CASE WHEN moves AND we IS NOT NULL THEN CASE WHEN eab THEN we - e ELSE we END ELSE 0 END AS de
  FROM (SELECT *, CASE WHEN fits AND raw > 1e-12 THEN (r0 + r1) / 2 END AS r, CASE WHEN cw THEN -raw ELSE raw END AS sweep
  FROM (SELECT * EXCLUDE (raw), CASE WHEN raw <= 1e-12 AND sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) <= 1e-9 THEN 2 * pi() ELSE raw END AS raw, r0 > 1e-9 AND abs(r0 - r1) <= greatest(0.05, 0.01 * greatest(r0, r1)) AS fits
  FROM (SELECT *, CASE WHEN cw THEN a0 - a1 ELSE a1 - a0 END + CASE WHEN CASE WHEN cw THEN a0 - a1 ELSE a1 - a0 END < 0 THEN 2 * pi() ELSE 0 END AS raw
  FROM (SELECT *, sqrt(wi * wi + wj * wj) AS r0, sqrt((nx - cx) * (nx - cx) + (ny - cy) * (ny - cy)) AS r1, atan2(y - cy, x - cx) AS a0, atan2(ny - cy, nx - cx) AS a1
  FROM (SELECT *, CASE WHEN flat AND cen AND wi IS NOT NULL THEN x + wi END AS cx, CASE WHEN flat AND cen AND wi IS NOT NULL THEN y + wj END AS cy
  FROM (SELECT w.run_id, w.k, w.marked, w.moves, w.g92, w.we, w.wi, w.wj, w.cw, m.x, m.y, m.z, m.e, m.t, m.layer, m.lz,
      CASE WHEN w.kind = 5 THEN w.d % 3 <> 0 ELSE m.ab END AS ab, CASE WHEN w.kind = 6 THEN w.d % 2 = 1 ELSE m.eab END AS eab, CASE WHEN w.kind = 12 THEN w.d <> 0 ELSE m.flat END AS flat, CASE WHEN w.kind = 13 THEN w.d <> 1 ELSE m.cen END AS cen,
      CASE WHEN w.wx IS NULL THEN m.x WHEN w.g92 OR m.ab THEN w.wx ELSE m.x + w.wx END AS nx, CASE WHEN w.wy IS NULL THEN m.y WHEN w.g92 OR m.ab THEN w.wy ELSE m.y + w.wy END AS ny, CASE WHEN w.wz IS NULL THEN m.z WHEN w.g92 OR m.ab THEN w.wz ELSE m.z + w.wz END AS nzz,
      coalesce(w.wf, m.f) AS f, coalesce(w.typ, m.typ) AS typ, coalesce(w.ap, m.ap) AS ap, coalesce(w.tr, m.tr) AS tr,
      m.waits OR w.mark AS waits, CASE WHEN w.mark THEN NULL WHEN m.waits AND w.nz IS NOT NULL THEN w.nz ELSE m.nz END AS nz
    FROM m JOIN ws w ON w.run_id = m.run_id AND w.k = m.k + 1)))))))))),
n AS (SELECT *, CASE WHEN r IS NULL THEN 1 ELSE greatest(1, ceil(r * abs(sweep) / 0.5), ceil(abs(sweep) / radians(10)))::INT END AS n FROM m WHERE moves)
SELECT run_id, (k - 1)::INT AS line, n::BIGINT AS n, round(x, 4) AS x1, round(y, 4) AS y1, round(z, 4) AS z1,
  round(x + coalesce(list_sum(list_transform(range(1, n), lambda j: cx + r * cos(a0 + sweep * j / n))), 0), 4) AS sum_x, round(y + coalesce(list_sum(list_transform(range(1, n), lambda j: cy + r * sin(a0 + sweep * j / n))), 0), 4) AS sum_y,
  round(de, 4) AS e, round(len, 4) AS length, round(t, 4) AS t_end, round(t0, 4) AS t_start, round(f / 60, 4) AS feed_mm_s, typ AS feature, ext AS extruding, layer, round(CASE WHEN layer >= 0 THEN lz END, 4) AS layer_z
FROM n""",
}
