"""A whole run over one raw log: read, mined, written to a folder of its own, measured."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import align, by_complexity, by_frequency, contingency, metrics_of_slices
from ..operators.matching import event_ids
from ..operators.mine import Inducer, Settings, mine_with_lineage, offline, usage
from ..sources.logs import read_raw_log
from ..sources.presets import PRESETS
from ..sources.sinks import append_metrics, write_lines, write_templates, write_trace
from .storage import keep


def run_folder(out: str, dataset: str) -> str:
    """A folder below ``out`` that no other run has: the data set's, the time in UTC and a random number."""
    return f"{out.rstrip('/')}/{dataset}/{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def slices_of(complexities: tuple[int, ...] = (), frequencies: tuple[int, ...] = ()) -> dict:
    """Slices of the labelled templates to measure: `all`, classes of complexity, and percents of the rarest (or, negative, of the commonest)."""
    return {"all": F.lit(True)} | {f"complexity {k}": by_complexity(k) for k in complexities} | {f"frequency {k}": by_frequency(k) for k in frequencies}


def mine_log(
    spark: SparkSession, path: str, out: str, dataset: str, log_format: str | None = None, settings: Settings | None = None, inducer: Inducer = offline, truth: DataFrame | None = None,
    normalize_labels: bool = False, complexities: tuple[int, ...] = (), frequencies: tuple[int, ...] = (),
) -> str:
    """Mine the raw log at ``path`` and return the folder that holds the results.

    ``dataset`` names the run and, if there is a preset of that name, gives the format and the masks; ``log_format`` and
    ``settings`` replace them. The folder holds `lines`, `templates` (CSV), `trace`, `lineage`, `settings` and `run`
    (JSON). `run` has the lines read and loaded, the seconds of reading and of mining, lines a second, the inductions and a model's queries
    and seconds. With ``truth`` (line_id, event_template; line_id is the physical line in the file) measures of
    each slice are in `metrics` too, and are added to ``out``/metrics, the table of all runs. Lines without label don't count.

    Raises ValueError if no line fits the format, before anything is written, and if ``dataset`` has no preset and there is no format.
    """
    if log_format is None and dataset not in PRESETS:
        raise ValueError(f"no format is known for {dataset}")
    chosen = settings or (Settings.of(dataset) if dataset in PRESETS else Settings())
    options, began, counts = chosen.options(), time.perf_counter(), Observation("run")
    lines = keep(read_raw_log(spark, path, log_format or dataset, counts).select("line_id", "content"))
    loaded = time.perf_counter()
    labelled, trace, lineage = mine_with_lineage(lines, inducer=inducer, **options)
    labelled, trace = keep(event_ids(labelled)), keep(trace)
    mined = time.perf_counter()

    folder = run_folder(out, dataset)
    write_lines(labelled, f"{folder}/lines")
    write_templates(labelled, f"{folder}/templates")
    write_trace(trace, f"{folder}/trace")
    lineage.write.json(f"{folder}/lineage")
    spark.createDataFrame([(dataset, json.dumps(asdict(chosen)))], "dataset string, settings string").write.json(f"{folder}/settings")
    seen = counts.get
    run = usage(trace).select(
        F.lit(dataset).alias("dataset"), F.lit(path).alias("path"), F.lit(seen["lines"]).alias("lines"), F.lit(seen["loaded"]).alias("loaded"), F.lit(round(loaded - began, 3)).alias("read_seconds"), F.lit(round(mined - loaded, 3)).alias("mine_seconds"),
        F.lit(round(seen["loaded"] / max(mined - began, 1e-9), 3)).alias("lines_per_second"), "inductions", "queries", F.col("seconds").alias("model_seconds"),
    )
    run.write.json(f"{folder}/run")
    if truth is not None:
        pairs = align(truth.select("line_id", F.col("event_template").alias("template")), labelled.select("line_id", "template"), normalize_labels)
        measured = keep(metrics_of_slices(contingency(pairs), slices_of(complexities, frequencies)).select(F.lit(dataset).alias("dataset"), F.lit(folder).alias("run"), "*"))
        append_metrics(measured, f"{folder}/metrics")
        append_metrics(measured, f"{out.rstrip('/')}/metrics")
    return folder
