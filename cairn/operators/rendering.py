"""Findings as JSON and Markdown, one document per asset, built by aggregation on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .scoring import remediations

DASH = "—"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def number(x: Column) -> Column:
    """A number with one decimal, as the scorecard shows it."""
    return F.format_string("%.1f", x)


def _lines(rows: DataFrame, line: Column, order: str, name: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy("asset_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias(name))


def _table(head: list[str], body: str) -> Column:
    top = f"| {' | '.join(head)} |\n|{'---|' * len(head)}\n"
    return F.concat(F.lit(top), F.col(body))


def criterion_lines(checks: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in fixed.STATUS_LABELS.items() for x in kv])
    line = F.concat(F.lit("| "), "id", F.lit(" | "), F.coalesce(F.try_element_at(labels, F.col("status")), F.upper("status")), F.lit(" | "), F.substring(escaped(F.col("evidence")), 1, 180), F.lit(" | "), F.coalesce(F.nullif(escaped(F.col("remediation")), F.lit("")), F.lit(DASH)), F.lit(" |"))
    return _lines(checks, line, "seq", "criteria")


def per_asset_lines(checks: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), "id", F.lit(" | "), "dimension", F.lit(" | "), "status", F.lit(" | "), number(F.col("points_awarded")), F.lit("/"), F.col("points_possible").cast("int").cast("string"), F.lit(" | "), F.substring(escaped(F.col("evidence")), 1, 180), F.lit(" |"))
    return _lines(checks, line, "seq", "own_checks")


def remedy_lines(checks: DataFrame) -> DataFrame:
    line = F.concat(F.col("rank").cast("string"), F.lit(". **["), "id", F.lit(", "), F.col("points_possible").cast("int").cast("string"), F.lit(" pts at stake]** "), "remediation")
    return _lines(remediations(checks), line, "rank", "remedies")


def layout_lines(assessed: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **`"), "name", F.lit("`** ("), F.col("layout.orientation"), F.lit("): "), F.coalesce("prose", F.lit("")))
    if "notes" in assessed.columns:
        line = F.concat(line, F.array_join(F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("\n  - "), n)), ""))
    return _lines(assessed, line, "ordinal", "layouts")


def codec_lines(inspected: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), "name", F.lit(" | "), F.coalesce("codec", F.lit(DASH)), F.lit(" | "), "status", F.lit(" | "), escaped(F.col("note")), F.lit(" |"))
    return _lines(inspected, line, "ordinal", "codecs")


def benchmark_lines(trials: DataFrame) -> DataFrame:
    config = F.when(F.col("is_current"), F.concat(F.lit("**"), "config", F.lit(" (current)**"))).otherwise(F.col("config"))
    ratio = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), escaped(F.col("error")))).otherwise(F.concat(F.format_string("%.3f", "ratio"), F.lit("x")))
    speed = lambda c: F.coalesce(F.format_string("%.1f", c), F.lit(DASH))
    return _lines(trials, F.concat(F.lit("| "), config, F.lit(" | "), ratio, F.lit(" | "), speed("compress_mbps"), F.lit(" | "), speed("decompress_mbps"), F.lit(" |")), "seq", "trials")


def breach_lines(breaches: DataFrame) -> DataFrame:
    return _lines(breaches, F.concat(F.lit("| "), F.coalesce(F.col("stage"), F.lit("?")), F.lit(" | "), escaped(F.col("message")), F.lit(" |")), "seq", "breaches")


def smoke_block(smoke: DataFrame) -> DataFrame:
    """(``asset_id``, ``smoked``) from what a trial read measured; any number may be missing."""
    text = lambda c, unit="": F.concat(F.coalesce(F.col(c).cast("string"), F.lit(DASH)), F.lit(unit))
    cells = ["status", "requests_to_open", "bytes_to_open", ("time_to_open_s", " s"), ("ttfb_s", " s"), ("throughput_mbps", " MB/s"), "total_bytes"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[text(*c) if isinstance(c, tuple) else text(c) for c in cells]), F.lit(" |"))
    head = F.lit("| Status | Requests-to-open | Bytes-to-open | Time-to-open | Subset TTFB | Throughput | Total bytes |\n" + "|" + "---|" * 7 + "\n")
    skipped = F.when(F.col("status") == "skipped", F.concat(F.lit("\n\n> **No trial read was made, so confidence is reduced.** Reason: "), F.coalesce("reason", F.lit("unknown")))).otherwise("")
    return smoke.select("asset_id", F.concat(head, row, skipped).alias("smoked"))


def _profile_table() -> Column:
    """The three-profile table from the map column ``marks`` (check id to status and evidence)."""
    marks = F.create_map(*[F.lit(x) for kv in fixed.STATUS_MARKS.items() for x in kv])
    rows = []
    for label, cid, best, reads in fixed.PROFILE_ROWS:
        own = F.try_element_at(F.col("marks"), F.lit(cid))
        mark = F.coalesce(F.try_element_at(marks, own["status"]), F.lit(fixed.STATUS_MARKS["skipped"]))
        now = F.when(own.isNull(), DASH).otherwise(F.concat(F.coalesce("format", F.lit(DASH)), F.lit(": "), mark, F.lit(" "), F.substring(escaped(own["evidence"]), 1, 90)))
        keep = F.when(own["status"] == "pass", f"keep as-is ({best})").otherwise(best)
        rows.append(F.concat(F.lit(f"| {label} | "), now, F.lit(" | "), keep, F.lit(f" | {reads} |")))
    return F.concat(F.lit("| Profile | Now | Recommended | Expected requests |\n|---|---|---|---|\n"), F.array_join(F.array(*rows), "\n"))


def _or_none(name: str, why: str) -> Column:
    return F.coalesce(F.col(name), F.lit(f"_not assessed {DASH} {why}._"))


def render(scores: DataFrame, checks: DataFrame, assets: DataFrame, assessed: DataFrame | None = None, inspected: DataFrame | None = None, trials: DataFrame | None = None, breaches: DataFrame | None = None, smoke: DataFrame | None = None, frames: DataFrame | None = None, profile: str | None = None, style: str = "both", walks: DataFrame | None = None) -> DataFrame:
    """(``asset_id``, ``report``): Markdown in the style ``verdict``, ``score`` or ``both``.

    Sections without input say that they were not assessed; nothing fails for a missing part.
    ``frames`` (``asset_id``, ``frame``) is the JSON text of what was sampled, shown up to 3,000 characters;
    ``walks`` (``asset_id``, ``objects_visited``, ``complete``) tells how far the walk over the metadata came.
    """
    if style not in ("verdict", "score", "both"):
        raise ValueError(f"unknown style {style!r}")
    marks = F.map_from_entries(F.collect_list(F.struct("id", F.struct("status", "evidence")))).alias("marks")
    out = assets.select("asset_id", "format", "requests_to_open").join(scores, "asset_id")
    parts = [(criterion_lines(checks), "criteria"), (per_asset_lines(checks), "own_checks"), (remedy_lines(checks), "remedies"), (checks.groupBy("asset_id").agg(marks), "marks")]
    parts += [(f(x) if x is not None else None, n) for f, x, n in ((layout_lines, assessed, "layouts"), (codec_lines, inspected, "codecs"), (benchmark_lines, trials, "trials"), (breach_lines, breaches, "breaches"))]
    parts += [(smoke_block(smoke) if smoke is not None else None, "smoked"), (frames.select("asset_id", "frame") if frames is not None else None, "frame")]
    walked = F.concat(F.lit("; full-metadata-walk="), F.col("objects_visited").cast("string"), F.lit(" objects (complete="), F.coalesce(F.col("complete").cast("string"), F.lit(DASH)), F.lit(")"))
    parts.append((walks.select("asset_id", walked.alias("walked")) if walks is not None else None, "walked"))
    for frame, name in parts:
        out = out.join(frame, "asset_id", "left") if frame is not None else out.withColumn(name, F.lit(None).cast("string"))
    points = [F.concat(F.lit(f"| {d} | {what} | "), number(F.col(f"dim_{d.lower()}")), F.lit(f" | {w} |\n")) for d, w, what in fixed.DIMENSIONS]
    opened = F.coalesce(F.concat(F.lit("requests-to-open="), F.col("requests_to_open").cast("string"), F.coalesce("walked", F.lit("; full-metadata-walk=not walked"))), F.lit(f"not assessed {DASH} no telemetry recorded"))
    card = F.concat(F.lit("## Scorecard\n\n| Dimension | What | Score | Max |\n|---|---|---|---|\n"), *points, F.lit("| **Total** | | **"), number(F.col("score")), F.lit("** | **100** |\n| Metadata dispersal | "), opened, F.lit(f" | {DASH} | {DASH} |"))
    line = F.concat(F.lit("**Verdict: "), "verdict", F.lit(f" {DASH} "), "verdict_reason", F.lit("**"))
    graded = F.concat(line, F.lit("\nTier "), "tier", F.lit(" · "), number(F.col("score")), F.lit("/100 · confidence "), "confidence")
    section = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), body)
    blocks = [line if style == "verdict" else graded, F.concat(F.lit("# Cloud readiness: "), "asset_id")]
    scored = style in ("score", "both")
    if scored:
        blocks.append(card)
    if style in ("verdict", "both"):
        blocks.append(section("Criteria", _table(["Check", "Status", "Evidence", "Remediation"], "criteria")))
    blocks.append(section(f"Chunk layout {DASH} what it's optimized for", _or_none("layouts", "no variables were assessed")))
    blocks.append(section("Budget / stage breaches", F.coalesce(_table(["Stage", "Detail"], "breaches"), F.lit("No stage passed its caps."))))
    if scored:
        blocks.append(section("Per-asset findings", _table(["Check", "Dim", "Status", "Pts", "Evidence"], "own_checks")))
        blocks.append(section("Smoke-test telemetry", _or_none("smoked", "smoke test was not run for this asset")))
        blocks.append(section("Compression", F.concat(F.coalesce(_table(["Variable", "Codec", "Status", "Note"], "codecs"), F.lit("_not assessed_")), F.coalesce(F.concat(F.lit("\n\n"), _table(["Config", "Ratio", "Compress MB/s", "Decompress MB/s"], "trials")), F.lit("")))))
        blocks.append(section("Chunking recommendations (all three profiles)", F.concat(F.lit("> A chunk is read whole or not at all: one too large is a tax on every partial read,\n> one too small on every bulk read.\n\n"), _profile_table(), F.lit("\n\n" + (f"Primary intended profile: **{profile}**." if profile else "No primary profile was stated; the table covers all three.")))))
    blocks.append(section("Prioritized remediation", F.coalesce("remedies", F.lit("No check failed; nothing to remedy."))))
    if scored:
        shown = F.concat(F.lit("```json\n"), F.substring("frame", 1, 3000), F.lit("\n```"))
        blocks.append(section("Sample frame (reproducibility)", F.coalesce(shown, F.lit(f"_not assessed {DASH} this run kept no sample frame._"))))
    return out.select("asset_id", F.concat_ws("\n\n", *blocks).alias("report"))


def findings_json(scores: DataFrame, checks: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(``asset_id``, ``findings``): one JSON document per asset, keys in alphabetic order.

    ``more`` has a row per asset; its other columns become further keys of the document.
    """
    fields = ["dimension", "evidence", "id", "points_awarded", "points_possible", "remediation", "status"]
    listed = checks.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("checks"))
    dims = F.struct(*[F.struct(F.lit(w).alias("max"), F.col(f"dim_{d.lower()}").alias("score")).alias(d) for d, w, _ in fixed.DIMENSIONS]).alias("dimensions")
    keys = {"asset_id": F.col("asset_id"), "caps_applied": F.col("caps").alias("caps_applied"), "checks": F.col("checks"), "confidence": F.col("confidence"), "dimensions": dims, "score": F.col("score"), "tier": F.col("tier"), "verdict": F.col("verdict"), "verdict_reason": F.col("verdict_reason")}
    rows = scores.join(listed, "asset_id")
    if more is not None:
        rows = rows.join(more, "asset_id", "left")
        keys |= {n: F.col(n) for n in more.columns if n != "asset_id"}
    document = F.struct(*[keys[n] for n in sorted(keys)])
    return rows.select("asset_id", F.to_json(document).alias("findings"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder per asset below ``path``, its report as a text file."""
    reports.withColumnRenamed("report", "value").write.mode("overwrite").partitionBy("asset_id").option("lineSep", "\n").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, one document per asset."""
    findings.select(F.col("findings").alias("value")).write.mode("overwrite").text(path)
