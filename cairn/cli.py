"""Assess the assets at a path: ``python -m cairn.cli PATH [--out DIR] [--report-style both] ...``.

Exit status: 0 assessed, 2 nothing could be read or no access, 3 unknown format, 4 no variable matches, 5 an
argument is missing or something unforeseen failed.

The engine sends no request of its own for access checks: ``--probes`` and ``--records`` name tables of what probes
and catalogue lookups answered elsewhere.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .functions import fixed
from .operators import access, compression, conventions, inventory, rendering, sampling, telemetry
from .plans import assess
from .session import builder
from .sources import optional, parquet_footer, store_layout, zarr_chunks

VERSION = "0.2.0"


class MissingInput(ValueError):
    """An argument is needed that nobody can be asked for."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description="Assess how ready datasets are for reading over a network.")
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    p.add_argument("path", nargs="?", metavar="INPUT", help="a path, an address, or a granule's id with --records")
    p.add_argument("--granule-id", help="take the address from this granule's record")
    p.add_argument("--probes", help="Parquet table of what probes answered: asset_id, seq, stage, status_code, error, etag, seconds")
    p.add_argument("--records", help="Parquet table of catalogue records: asset_id (the granule's id or the input), record (JSON)")
    p.add_argument("--no-network", action="store_true", help="take no access answer into account")
    for name in ("--credentials-url", "--llm-model"):
        p.add_argument(name, help="accepted and not used: the engine neither signs in nor asks a model")
    for name in ("--earthaccess-fallback", "--anon", "--non-interactive"):
        p.add_argument(name, action="store_true", help="accepted and not used: the engine neither signs in nor asks")
    p.add_argument("--format", default="auto", help="take this format instead of looking at the files")
    p.add_argument("--variables", help="comma-separated names, parts of names or numbers; 'all' for all")
    p.add_argument("--all-variables", action="store_true")
    p.add_argument("--use-case", choices=("timeseries", "maps", "balanced"))
    p.add_argument("--profile", choices=("interactive", "training", "agentic"))
    p.add_argument("--suggest", nargs="?", const="heuristic", choices=("heuristic", "llm"), help="print the ranked variables and stop")
    p.add_argument("--benchmark", action=argparse.BooleanOptionalAction, default=False, help="try a grid of codecs on one stored chunk")
    p.add_argument("--bitround-max-abs-error", type=float, help="with --benchmark, also try rounding within this error")
    p.add_argument("--style", "--report-style", dest="style", choices=("verdict", "score", "both"), default="both")
    p.add_argument("--byte-cap", type=float, default=fixed.MAX_BYTES / fixed.MIB, help="MB that opening may read")
    p.add_argument("--time-cap", type=float, default=float(fixed.MAX_SECONDS), help="seconds that a stage may take")
    p.add_argument("--out", help="folder for reports and findings; without it the scores are printed")
    p.add_argument("--json", action="store_true", help="print the findings too")
    p.add_argument("-v", "--verbose", action="store_true", help="print how long the stages took")
    return p


def keyed(files: DataFrame, path: str) -> DataFrame:
    """``files`` of a store with ``asset_id`` and their ``key`` below the store's root."""
    root = "/" + path.split("://")[-1].strip("/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return files.withColumn("asset_id", F.lit(root.rsplit("/", 1)[-1])).withColumn("key", F.substring(plain, len(root) + 2, 1 << 30))


def load(spark: SparkSession, path: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(assets, variables) of a path in one format."""
    from .schema import ASSETS, VARIABLES, conform

    if fmt == "parquet":
        rows = parquet_footer.footers(spark, path)
        return parquet_footer.assets(rows), parquet_footer.variables(rows)
    if fmt in ("zarr", "icechunk"):
        documents = keyed(store_layout.read_documents(spark, path), path).select("asset_id", "key", "document")
        root = documents.filter(~F.contains("key", F.lit("/")))
        names = keyed(store_layout.list_keys(spark, path), path).select("asset_id", F.substring_index("key", "/", 1).alias("key"), F.lit(None).cast("string").alias("document")).filter(F.col("key").isin("refs", "snapshots", "manifests")).distinct()
        found = store_layout.sniff_store(root.union(names)).join(store_layout.root_attributes(root), "asset_id", "left")
        opened = store_layout.open_cost(documents)
        return conform(found.join(opened, "asset_id", "left").withColumn("smoke_status", F.lit("pass")), ASSETS), store_layout.zarr_variables(documents)
    if fmt in optional.READERS:
        one = spark.createDataFrame([(path.rsplit("/", 1)[-1], path, fmt)], "asset_id string, path string, format string")
        rows = optional.open_assets(one)
        return conform(optional.asset_rows(rows).withColumn("format", F.lit(fmt)), ASSETS), conform(rows.filter("status = 'ok'"), VARIABLES)
    one = spark.createDataFrame([(path.rsplit("/", 1)[-1], fmt, "skipped")], "asset_id string, format string, smoke_status string")
    return conform(one, ASSETS), conform(spark.createDataFrame([], "asset_id string"), VARIABLES)


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a path: a store's layout, else the first file's head, else its extension."""
    from .sources import heads

    keys = store_layout.read_documents(spark, path) if not path.endswith(".parquet") else None
    if keys is not None and not keys.limit(1).isEmpty():
        return "zarr"
    if keys is not None:
        names = keyed(store_layout.list_keys(spark, path), path).select("asset_id", F.substring_index("key", "/", 1).alias("key"), F.lit(None).cast("string").alias("document"))
        store = store_layout.sniff_store(names.filter(F.col("key").isin(*store_layout.META_KEYS)).distinct()).first()
        if store is not None and store["format"] != "unknown":
            return store["format"]
    head = heads.heads(spark, path).select(formats.sniff_bytes(F.col("head")).alias("f"), formats.ext_hint(F.col("path")).alias("e")).first()
    if head is None:
        return "unknown"
    found = head["f"] if head["f"] != "unknown" else head["e"] or "unknown"
    return optional.refine_hdf5(path)[0] if found == "hdf5" else found


def resolved(spark: SparkSession, args: argparse.Namespace):
    """The access row of the input: address, ``auth``, etag, catalogue facts and findings. One input is one row."""
    asked = args.granule_id or args.path
    tables = [spark.read.parquet(p) if p else None for p in (args.probes, args.records)]
    tables = [t if t is None else t.filter(F.col("asset_id").isin(asked, args.path or asked)).withColumn("asset_id", F.lit(asked)) for t in tables]
    return access.resolve_access(spark.createDataFrame([(asked, asked)], "asset_id string, input string"), *tables, no_network=args.no_network).first()


def with_access(assets: DataFrame, row) -> tuple[DataFrame, DataFrame]:
    """``assets`` with the input's etag and catalogue facts, and its findings for each of them."""
    from .schema import ASSETS, FINDINGS, conform

    cmr = F.from_json(F.lit(json.dumps(row["cmr"].asDict()) if row["cmr"] else None), assets.schema["cmr"].dataType)
    told = F.from_json(F.lit(json.dumps([f.asDict() for f in row["findings"]])), f"array<{access.FINDING}>")
    found = assets.select("asset_id", F.posexplode(told).alias("seq", "f")).select("asset_id", "seq", "f.*")
    return conform(assets.withColumn("etag", F.coalesce("etag", F.lit(row["etag"]))).withColumn("cmr", F.coalesce("cmr", cmr)), ASSETS), conform(found, FINDINGS)


def breaches(assets: DataFrame, took: dict[str, float], args: argparse.Namespace) -> DataFrame:
    """(``asset_id``, ``seq``, ``stage``, ``message``): stages that took too long, and opens that read too much."""
    stages = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(float(s)).alias("elapsed_s"), F.lit(i).cast("bigint").alias("seq")) for i, (n, s) in enumerate(took.items())])
    rows = assets.select("asset_id", F.inline(stages))
    late = telemetry.stage_breaches(rows, args.time_cap).filter("breached").select("asset_id", "seq", "stage", F.format_string(f"%.1f s passed the cap of {args.time_cap:g} s", "elapsed_s").alias("message"))
    opens = assets.select("asset_id", F.lit(-1).cast("bigint").alias("seq"), F.col("bytes_to_open").alias("bytes"))
    over = telemetry.first_breaches(opens, int(args.byte_cap * fixed.MIB)).select("asset_id", "seq", F.lit("open").alias("stage"), "message")
    return late.union(over)


def run(args: argparse.Namespace) -> int:
    if not (args.path or args.granule_id):
        raise MissingInput("INPUT is missing; give a path, an address or --granule-id")
    spark = builder("cairn").getOrCreate()
    row = resolved(spark, args)
    if row["auth"] == "error":
        for f in row["findings"]:
            print(f"{f['id']}: {f['evidence']}" + (f" ({f['remediation']})" if f["remediation"] else ""), file=sys.stderr)
        return 2
    path, took, began = row["url"], {}, time.monotonic()
    try:
        fmt = sniff(spark, path) if args.format == "auto" else args.format
    except Exception as e:
        print(f"cannot read {path}: {type(e).__name__}: {e}", file=sys.stderr)
        return 2
    if fmt == "unknown":
        print(f"the format of {path} is unknown; pass --format, one of {', '.join(formats.supported_formats())}", file=sys.stderr)
        return 3
    assets, variables = load(spark, path, fmt)
    assets, findings = with_access(assets, row)
    if args.suggest:
        if args.suggest == "llm":
            print("no model is asked here; the ranking follows", file=sys.stderr)
        inventory.rank_variables(variables, 10).select("asset_id", "rank", "name", "shape", "dtype").orderBy("asset_id", "rank").show(50, truncate=False)
        return 0
    tokens, every = None, args.all_variables or (args.variables or "").strip().lower() == "all"
    if args.variables and not every:
        answers = assets.select("asset_id", F.lit(args.variables).alias("raw"))
        tokens = inventory.parse_selection(variables, answers).select("asset_id", "token")
        missing = [r["token"] for r in inventory.unmatched_tokens(variables, tokens).select("token").distinct().collect()]
        if missing:
            print(f"no variable matches {', '.join(missing)}", file=sys.stderr)
            return 4
    took["open"] = time.monotonic() - began
    keys = keyed(store_layout.list_keys(spark, path), path) if fmt == "zarr" else None
    measured = sampling.sample_listed(variables, keys) if keys is not None else None
    found = assess.assess(assets, variables, findings=findings, measured=measured, tokens=tokens, every=every, use_case=args.use_case)
    held = [f.persist() for f in (found.scores, found.checks)]
    found.scores, found.checks = held
    found.scores.count()
    samples = zarr_chunks.bearing(zarr_chunks.samples(found.selected, keys)) if args.benchmark and keys is not None else None
    inspected, trials = compression.assess_compression(found.selected, samples, args.bitround_max_abs_error)
    if trials is not None:
        # Speeds differ from run to run, so the trials run once for the report and the findings.
        trials = trials.persist()
        held.append(trials)
        trials.count()
    took["assessments"] = time.monotonic() - began
    broken = breaches(assets, took, args)
    names = found.selected.groupBy("asset_id").agg(F.array_sort(F.collect_set("name")).alias("variables_assessed"))
    names = assets.select("asset_id").join(names, "asset_id", "left").withColumn("variables_assessed", F.coalesce("variables_assessed", F.array().cast("array<string>")))
    frame = F.struct(F.lit(row["input"]).alias("input"), F.lit(fmt).alias("format"), "variables_assessed", F.lit(args.byte_cap).alias("byte_cap_mb"), F.lit(args.time_cap).alias("time_cap_s"))
    frames = names.select("asset_id", frame.alias("sample_frame"))
    smoke = assets.select("asset_id", F.col("smoke_status").alias("status"), "requests_to_open", "bytes_to_open", *[F.lit(None).cast("double").alias(c) for c in ("time_to_open_s", "ttfb_s", "throughput_mbps")], F.lit(None).cast("bigint").alias("total_bytes"), F.lit(None).cast("string").alias("reason"))
    if args.out or args.json:
        more = frames.join(broken.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stage", "message"))).alias("budget_breaches")), "asset_id", "left").join(found.cf.select("asset_id", F.col("checks").alias("cf"), F.col("status").alias("cf_status")), "asset_id", "left")
        if fmt in ("zarr", "icechunk"):
            more = more.join(conventions.check_geozarr(assets, variables).select("asset_id", F.col("status").alias("geozarr_status")), "asset_id", "left")
        if trials is not None:
            more = more.join(trials.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("seq", "config", "ratio", "error"))).alias("codec_trials")), "asset_id", "left")
        documents = rendering.findings_json(found.scores, found.checks, more)
    if args.out:
        shown = frames.select("asset_id", F.to_json("sample_frame").alias("frame"))
        reports = rendering.render(found.scores, found.checks, assets, found.assessed, inspected, trials, broken, smoke, shown, profile=args.profile, style=args.style)
        rendering.write_reports(reports, f"{args.out}/reports")
        rendering.write_findings(documents, f"{args.out}/findings")
    else:
        found.scores.select("asset_id", "score", "tier", "verdict", "confidence").show(truncate=False)
    if args.json:
        for r in documents.orderBy("asset_id").toLocalIterator():
            print(r["findings"])
    if args.verbose:
        print(", ".join(f"{n} {s:.1f} s" for n, s in took.items()), file=sys.stderr)
    for f in held:
        f.unpersist()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except MissingInput as e:
        print(f"error: {e}", file=sys.stderr)
    except Exception as e:  # the exit status tells a caller that this was not foreseen
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
    return 5


if __name__ == "__main__":
    sys.exit(main())
