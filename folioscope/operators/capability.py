"""Whether a machine can do the work, decided from rows of probes (machine, key, label, ok, detail, fix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of the probes, in order of the report.
KEYS = ("pymupdf", "lxml", "imaging", "converter", "ocr", "vision", "pandoc", "browser")


def module_probe(required: Column, present: Column) -> Column:
    """A struct of ok and the modules that are missing."""
    missing = F.array_except(required, present)
    return F.struct((F.size(missing) == 0).alias("ok"), missing.alias("missing"))


def converter_probe(windows: Column, bridge: Column, engines: Column) -> Column:
    """A struct of ok and detail for the converter: it needs the platform, its bridge and an engine."""
    lacking = F.when(~windows, "not Windows").when(~bridge, "bridge missing").when(F.size(engines) == 0, "no engine")
    return F.struct(lacking.isNull().alias("ok"), F.coalesce(lacking, F.array_join(engines, " + ")).alias("detail"))


def first_success(*tries: Column) -> Column:
    """The first engine's output that is there."""
    return F.coalesce(*tries)


def device_path(path: Column) -> Column:
    """``C:\\a\\b`` as ``/C/a/b``."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^([A-Za-z]):", "$1"), r"\\", "/"))


def verdict(probes: DataFrame) -> DataFrame:
    """One row per machine: usable capabilities in order of preference, exit code (0, 1 or 4) and limits.

    The converter counts only where its reader is there as well. A machine without the page library cannot start (1);
    one without any capability cannot verify (4). A probe that is missing counts as not ok.
    """
    wide = probes.groupBy("machine").pivot("key", list(KEYS)).agg(F.max(F.col("ok")))
    ok = lambda k: F.coalesce(F.col(k), F.lit(False))
    usable = F.array_compact(F.array(F.when(ok("converter") & ok("lxml"), "converter"), F.when(ok("ocr"), "ocr"), F.when(ok("vision"), "vision")))
    code = F.when(~ok("pymupdf"), 1).when(F.size("usable") > 0, 0).otherwise(4)
    seen = ok("ocr") | ok("vision")
    limits = F.array_compact(
        F.array(
            F.when(ok("converter") & ~ok("lxml"), "converter: unusable without its reader"),
            F.when(~ok("imaging"), "panels: cannot be split").when(~seen, "panels: geometry only").when(~ok("ocr"), "panels: no label check"),
            F.when(~seen, "scanned: cannot be read"),
            F.when(~ok("converter"), "figures: positions are guessed"),
            F.when(~ok("vision"), "captions: pairing is not checked by eye"),
        )
    )
    none = F.array().cast("array<string>")
    return wide.withColumn("usable", usable).withColumn("code", code).select("machine", "usable", "code", F.when(F.col("code") == 0, limits).otherwise(none).alias("limits"))


def report(probes: DataFrame) -> DataFrame:
    """One row per machine: its probes as lines, in order, with a hint under those that failed."""
    order = F.array_position(F.array(*map(F.lit, KEYS)), F.col("key"))
    hint = F.when(~F.col("ok") & (F.coalesce("fix", F.lit("")) != ""), F.concat(F.lit("\n      -> "), "fix")).otherwise(F.lit(""))
    line = F.concat(F.when(F.col("ok"), "  ok  ").otherwise("  NO  "), F.rpad("label", 22, " "), F.lit(" "), F.coalesce("detail", F.lit("")), hint)
    return probes.groupBy("machine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("report"))
