"""Saved runs: NPZ files in, Parquet, JSON and CSV out, a catalogue, annotations and weights."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import scalar
from sensorloom.plans import tables
from sensorloom.sources.shared import materialise

SIGNALS = "kind string, run_id string, metric string, seq long, t double, v double"
INFO = "kind string, run_id string, path string, mtime timestamp, n_force long, scalars string, error string"
#: Kinds by file prefix, and the clock and value arrays of each metric: fixed values of the file format.
PREFIXES = {"run": "sweep", "flow": "flow", "probe": "probe", "livemap": "map"}
STREAMS = {"loadcell_value": [("force_t", "force_y")], "pos_x": [("pos_t", "pos_x"), ("pos_x_t", "pos_x")], "pos_y": [("pos_y_t", "pos_y")], "pos_z": [("pos_z_t", "pos_z")], "loss": [("loss_t", "loss_n")]}


def _names(path: str) -> tuple[str | None, str]:
    base = path.rsplit("/", 1)[-1]
    return PREFIXES.get(base.split("_", 1)[0]), base.removesuffix(".npz")


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def _signals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, raw in zip(pdf.path, pdf.content):
            kind, run = _names(path)
            try:
                held = _arrays(raw)
            except Exception:  # the catalogue reports what can't be read
                continue
            for metric, pairs in STREAMS.items():
                for tk, vk in pairs:
                    if tk in held and vk in held:
                        n = min(len(held[tk]), len(held[vk]))
                        yield pd.DataFrame({"kind": kind, "run_id": run, "metric": metric, "seq": np.arange(n), "t": held[tk][:n].astype(float), "v": held[vk][:n].astype(float)})
                        break


def _info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, mtime, raw in zip(pdf.path, pdf.modificationTime, pdf.content):
            kind, run = _names(path)
            try:
                held = _arrays(raw)
                scalars = {k: a.reshape(-1)[0].item() for k, a in held.items() if a.size == 1 and a.dtype.kind in "fiubU"}
                scalars |= {k: a.tolist() for k, a in held.items() if k in ("k_values", "flow_levels", "bbox")}
                text = json.dumps({k: None if isinstance(x, float) and not np.isfinite(x) else x for k, x in scalars.items()})
                rows.append((kind, run, path, mtime, len(held.get("force_t", ())), text, None))
            except Exception as e:
                rows.append((kind, run, path, mtime, None, None, str(e)[:200]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INFO.split(", ")])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "{run,flow,probe,livemap}_*.npz").load(folder)


def read_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Long-form signals of all NPZ runs in a folder; unreadable files give none.  Pickled content is never loaded."""
    return _files(spark, folder).select("path", "content").mapInPandas(_signals, SIGNALS)


def catalogue(spark: SparkSession, folder: str, kind: str | None = None, errors: bool = False) -> DataFrame:
    """One row per run, newest first: kind, run_id, path, mtime, n_force, scalars (JSON), error.

    Runs that can't be read are left out unless `errors` is set.
    """
    found = _files(spark, folder).select("path", "modificationTime", "content").mapInPandas(_info, INFO)
    if kind:
        found = found.where(F.col("kind") == kind)
    return (found if errors else found.where("error is null")).orderBy(F.desc("mtime"), "run_id")


#: Defaults of parameters that a file doesn't hold: fixed values of the file format, those of files with
#: `sweep_params_json` first.
JSON_DEFAULTS = {"slow_half_s": 1.0, "fast_half_s": 0.25, "cycles_per_K": 14, "first_slow_leg_factor": 1.0, "inter_k_dwell_s": 0.0, "slow_feed_mm_s": 0.8, "fast_feed_mm_s": 8.0, "accel_mm_s2": 5000.0, "purge_z": 50.0, "z_marker_lift_mm": 2.0}
SWEEP_DEFAULTS = {"first_slow_leg_factor": 10.0, "inter_k_dwell_s": 0.0, "accel_mm_s2": 5000.0, "purge_z": 50.0, "z_marker_lift_mm": 2.0}
FLOW_DEFAULTS = {"filament_diameter": 1.75, "min_flow_mm3_s": 5.0, "max_flow_mm3_s": 30.0, "flow_step_mm3_s": 1.0, "dwell_s": 3.0, "settle_frac": 0.5, "warmup_s": 3.0, "tare_dwell_s": 1.5, "purge_z": 50.0, "z_marker_lift_mm": 2.0}
PROBE_DEFAULTS = {"dir_sign": 1.0, "start_x": 125.0, "start_y": 110.0, "probe_z": 5.0, "creep_mm": 1.0, "slow_feed_mm_min": 30.0, "travel_feed_mm_min": 3000.0, "n_touches": 5, "backoff_mm": 1.0, "settle_ms": 300}


def _held(key: str, source: str = "scalars") -> Column:
    return F.get_json_object(source, f"$.{key}")


def _number(key: str, defaults: dict[str, float], source: str = "scalars") -> Column:
    x = _held(key, source).cast("double")
    return F.coalesce(x, F.lit(float(defaults[key]))) if key in defaults else x


def sweep_runs(info: DataFrame) -> DataFrame:
    """The parameters that plans.tables and operators.sweep ask for, from a catalogue's sweeps: those of the file's
    `sweep_params_json` where that is a JSON object, else its scalars.  Files without a K list give no row; `coupled_dx`
    is null where a file without that text doesn't hold it (see with_amplitude)."""
    s = info.where("kind = 'sweep'").withColumn("_p", _held("sweep_params_json"))
    whole = F.coalesce(F.json_object_keys("_p").isNotNull(), F.lit(False))

    def num(key: str) -> Column:
        return F.when(whole, _number(key, JSON_DEFAULTS, "_p")).otherwise(_number(key, SWEEP_DEFAULTS))

    ks = F.from_json(F.when(whole, _held("K_values", "_p")).otherwise(_held("k_values")), "array<double>")
    dx = num("coupled_dx_mm")
    return s.select(
        "run_id", ks.alias("k_values"), _number("sweep_t0", {}).alias("sweep_t0"), num("slow_half_s").alias("slow_half_s"), num("fast_half_s").alias("fast_half_s"),
        num("cycles_per_K").cast("int").alias("cycles"), num("first_slow_leg_factor").alias("first_slow_leg_factor"), num("inter_k_dwell_s").alias("dwell_s"), num("slow_feed_mm_s").alias("slow_feed"), num("fast_feed_mm_s").alias("fast_feed"),
        num("accel_mm_s2").alias("accel"), F.when(whole | (dx > 0), dx).alias("coupled_dx"), num("purge_z").alias("purge_z"), num("z_marker_lift_mm").alias("lift"),
    ).where("k_values is not null")


def with_amplitude(params: DataFrame, signals: DataFrame) -> DataFrame:
    """sweep_runs() with unknown `coupled_dx` taken from the runs' pos_x: the 5-95 % range within 5 mm of the median, at
    least 0.02; 0.05 where fewer than 50 of its values lie there, or it has fewer than 10."""
    own = signals.where("metric = 'pos_x'").join(params.where("coupled_dx is null").select("run_id"), "run_id", "left_semi")
    middle = own.groupBy("run_id").agg(F.median("v").alias("_m"), F.count("v").alias("_n")).where("_n >= 10")
    near = own.join(middle, "run_id").where(F.abs(F.col("v") - F.col("_m")) <= 5)
    found = near.groupBy("run_id").agg(F.when(F.count("v") >= 50, F.greatest(F.lit(0.02), F.percentile("v", 0.95) - F.percentile("v", 0.05))).alias("_dx"))
    return params.join(found, "run_id", "left").withColumn("coupled_dx", F.coalesce("coupled_dx", "_dx", F.lit(0.05))).drop("_dx")


def _tools() -> list[Column]:
    """The printer's model and its tool: 0 for models that have but one."""
    model = scalar.printer_model(F.coalesce(_held("printer_model"), F.lit("COREONE")))
    return [model.alias("printer_model"), F.when(model == "COREONEINDX", F.coalesce(_held("tool_index").cast("int"), F.lit(0))).otherwise(0).alias("tool_index")]


def flow_runs(info: DataFrame) -> DataFrame:
    """The parameters of a catalogue's flow sweeps, as plans.tables.flow_segments asks for them; sweep_t0 is null where
    the file doesn't hold it."""
    short = {"min_flow_mm3_s": "min_flow", "max_flow_mm3_s": "max_flow", "flow_step_mm3_s": "step_flow", "z_marker_lift_mm": "lift"}
    return info.where("kind = 'flow'").select("run_id", _number("sweep_t0", {}).alias("sweep_t0"), *[_number(k, FLOW_DEFAULTS).alias(short.get(k, k)) for k in FLOW_DEFAULTS], *_tools())


def flow_levels(params: DataFrame) -> DataFrame:
    """(run_id, level_idx, level, dwell_s, settle_frac): the plan that operators.flow asks for."""
    return tables.flow_segments(params).join(params.select("run_id", "dwell_s", "settle_frac"), "run_id").select("run_id", "level_idx", F.col("flow_mm3_s").alias("level"), "dwell_s", "settle_frac")


def probe_runs(info: DataFrame) -> DataFrame:
    """The parameters of a catalogue's touch probes for plans.tables.probe_touches (`start`) and operators.probe
    (`standoff`, the same place, and `slow_mm_s`); `axis` is the probed one, X or Y."""
    axis = F.coalesce(_held("probe_axis"), F.lit("X"))
    p = info.where("kind = 'probe'").select("run_id", axis.alias("axis"), *[_number(k, PROBE_DEFAULTS).alias(k) for k in PROBE_DEFAULTS], *_tools())
    start = F.when(F.col("axis") == "X", F.col("start_x")).otherwise(F.col("start_y"))
    return p.withColumns({"dir_sign": F.when(F.col("dir_sign") > 0, 1).otherwise(-1), "n_touches": F.col("n_touches").cast("int"), "start": start, "standoff": start, "slow_mm_s": F.col("slow_feed_mm_min") / 60})


def probe_position(signals: DataFrame, params: DataFrame) -> DataFrame:
    """The positions of each run's probed axis."""
    axis = params.select("run_id", F.concat(F.lit("pos_"), F.lower("axis")).alias("metric"))
    return signals.join(axis, ["run_id", "metric"], "left_semi")


def read_programs(spark: SparkSession, folder: str) -> DataFrame:
    """The programs in the map runs of a folder, as operators.gcode asks for them, and where the run was joined: run_id,
    text, start_layer (0 unless known), start_z."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "livemap_*.npz").load(folder)
    return files.select("path", "content").mapInPandas(_programs, "run_id string, text string, start_layer int, start_z double")


def _programs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, raw in zip(pdf.path, pdf.content):
            try:
                held = _arrays(raw)
            except Exception:  # the catalogue reports what can't be read
                continue
            text = np.asarray(held.get("gcode_bytes", ()), dtype=np.uint8).tobytes().decode("utf-8", "replace")
            layer, z = (float(held[k].reshape(-1)[0]) if k in held and held[k].size else np.nan for k in ("attach_layer_index", "attach_axis_z"))
            yield pd.DataFrame({"run_id": [_names(path)[1]], "text": [text], "start_layer": [int(layer) if layer >= 0 else 0], "start_z": [z if np.isfinite(z) else None]})


def write_runs(signals: DataFrame, scalars: DataFrame, path: str, kind: str) -> None:
    """One NPZ per run, named by its run_id, in a folder: the streams in order of time, and the scalars of the run's row
    (arrays stay arrays).  A run is what one machine recorded in minutes, so that it fits in a task."""
    prefix = next(p for p, k in PREFIXES.items() if k == kind)
    fields = [c for c in scalars.columns if c != "run_id"]

    def save(key, streams: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        arrays = {c: np.atleast_1d(np.asarray(row[c].iloc[0])) for c in fields if len(row) and row[c].iloc[0] is not None}
        for metric, pairs in STREAMS.items():
            own = streams[streams.metric == metric].sort_values(["t", "seq"], kind="stable")
            tk, vk = pairs[-1] if kind in ("probe", "map") else pairs[0]
            arrays |= {tk: own.t.to_numpy(float), vk: own.v.to_numpy(float)} if len(own) else {}
        name = key[0] if key[0].startswith(f"{prefix}_") else f"{prefix}_{key[0]}"
        return pd.DataFrame({"run_id": [key[0]], "name": [f"{name}.npz"], "content": [to_npz(arrays)]})

    files = signals.groupBy("run_id").cogroup(scalars.groupBy("run_id")).applyInPandas(save, "run_id string, name string, content binary")
    files.write.mode("append").parquet(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The signals of the files that write_runs() made."""
    return spark.read.parquet(path).select(F.col("name").alias("path"), "content").mapInPandas(_signals, SIGNALS)


def lengths_that_differ(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, metric, n_t, n_v) of streams whose clock and values differ in length; exports refuse such runs."""
    return _files(spark, folder).select("path", "content").mapInPandas(_lengths, "run_id string, metric string, n_t long, n_v long")


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, raw in zip(pdf.path, pdf.content):
            try:
                held = _arrays(raw)
            except Exception:
                continue
            odd = [(_names(path)[1], m, len(held[t]), len(held[v])) for m, pairs in STREAMS.items() for t, v in pairs if t in held and v in held and len(held[t]) != len(held[v])]
            yield pd.DataFrame(odd, columns=["run_id", "metric", "n_t", "n_v"])


def meta_rows(info: DataFrame) -> DataFrame:
    """(run_id, key, value): what a run's file holds besides its streams, as texts, for the export's meta sheet."""
    held = F.from_json("scalars", "map<string,string>")
    return info.select("run_id", F.explode(held).alias("key", "value"))


def write_signals(signals: DataFrame, path: str) -> None:
    signals.write.mode("append").partitionBy("kind", "run_id").parquet(path)


def to_npz(arrays: dict[str, np.ndarray]) -> bytes:
    """One run's file, for tools that read NPZ."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def export_rows(signals: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """run_id, metric, t, t_rel_s, wall (UTC; null without an anchor: run_id, mono, unix), v, in order of time."""
    first = Window.partitionBy("run_id", "metric")
    rows = signals.withColumn("t_rel_s", F.col("t") - F.min("t").over(first))
    if anchors is not None:
        rows = rows.join(anchors.select("run_id", "mono", "unix"), "run_id", "left").withColumn("wall", F.timestamp_micros(F.round((F.col("t") - F.col("mono") + F.col("unix")) * 1e6).cast("bigint")))
    else:
        rows = rows.withColumn("wall", F.lit(None).cast("timestamp"))
    return rows.select("run_id", "metric", "seq", "t", "t_rel_s", "wall", "v")


def write_sheets(signals: DataFrame, path: str, anchors: DataFrame | None = None, meta: DataFrame | None = None, odd: DataFrame | None = None) -> None:
    """CSV files, one folder per run and stream, and one with the meta_rows() if given; an error if there are `odd`
    streams (lengths_that_differ())."""
    first = odd.first() if odd is not None else None
    if first:
        raise ValueError(f"{first.run_id}: {first.metric} has {first.n_t} times and {first.n_v} values")
    rows = export_rows(signals, anchors)
    rows.repartition("run_id", "metric").sortWithinPartitions("run_id", "metric", "t", "seq").write.mode("overwrite").partitionBy("run_id", "metric").option("header", True).csv(f"{path}/streams")
    if meta is not None:
        meta.write.mode("overwrite").option("header", True).csv(f"{path}/meta")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN and infinities become null."""
    clean = [scalar.finite_or_null(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def annotate(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Upserts (run_id, user_k_opt, notes) into the table at a path; a null K clears a run's.  Returns the new table.

    The new state is written beside the old and then takes its place as the
    latest version, so a reader always finds a whole one.
    """
    now = read_annotations(spark, path)
    kept = now.join(changes.select("run_id"), "run_id", "left_anti")
    merged = materialise(kept.unionByName(changes.select("run_id", F.col("user_k_opt").cast("double").alias("user_k_opt"), F.coalesce("notes", F.lit("")).alias("notes"))), "annotations")
    version = 1 + max(_versions(spark, path), default=0)
    merged.write.parquet(f"{path}/version-{version:08d}")
    return read_annotations(spark, path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version-")]
    return [int(p.getName()[8:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    found = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], "run_id string, user_k_opt double, notes string")
    return spark.read.parquet(f"{path}/version-{max(found):08d}")


def weights_table(spark: SparkSession, shipped: dict[str, float], optimised: dict[str, float] | None = None) -> DataFrame:
    """(metric, shipped, optimised, weight): optimised weights go before shipped ones, key by key."""
    keys = sorted({*shipped, *(optimised or {})})
    rows = [(k, shipped.get(k), (optimised or {}).get(k)) for k in keys]
    return spark.createDataFrame(rows, "metric string, shipped double, optimised double").withColumn("weight", F.coalesce("optimised", "shipped"))


def write_weights(spark: SparkSession, result: dict, path: str) -> None:
    """An optimiser's result (or any dict with `weights`) as one row of JSON."""
    spark.createDataFrame([(json.dumps(result),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_weights(spark: SparkSession, path: str) -> dict | None:
    """A weights file's content, weights scaled so that the largest is one; None if it is absent, no JSON or without weights."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    try:
        held = json.loads(spark.read.text(path, wholetext=True).first().value)
    except (ValueError, AttributeError):
        return None
    if not isinstance(held, dict) or not isinstance(held.get("weights"), dict):
        return None
    top = max(map(abs, held["weights"].values()), default=0)
    return held | {"weights": {k: v / top for k, v in held["weights"].items()} if top else held["weights"]}


def config_row(spark: SparkSession, text: str, defaults: dict) -> DataFrame:
    """One row of settings: the JSON text's over the defaults, unknown keys dropped."""
    given = json.loads(text) if text.strip() else {}
    return spark.createDataFrame([{k: given.get(k, v) for k, v in defaults.items()}])
