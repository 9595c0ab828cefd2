"""Source provenance per line item: gaps-and-islands over periods, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finfacts.functions.text import humanize, source_group_key, source_label

NO_PROVENANCE = "No source provenance returned by fetcher."
NO_DESCRIPTION = "No metadata available for this standardized line item."


def source_runs(src: DataFrame, keys: Sequence[str] = ("cik", "statement", "tag"), period: str = "period_ending",
                source: str = "source") -> DataFrame:
    """Runs of consecutive periods (newest first) whose sources share a grouping key.

    The window partitions are (company, statement, line item): at most one row
    per reporting period, whatever the size of a company.
    """
    keys = list(keys)
    s = (src.where(F.col(source).isNotNull() & (F.col(source) != ""))
            .select(*keys, period, F.col(source).alias("_src"), source_group_key(source).alias("_k")))
    w = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    brk = F.when(F.lag("_k").over(w) == F.col("_k"), 0).otherwise(1)
    s = s.withColumn("_b", brk).withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = (s.groupBy(*keys, "run")
             .agg(F.max(period).alias("start"), F.min(period).alias("end"),
                  F.max_by("_src", period).alias("_first"), F.count(F.lit(1)).alias("periods")))
    # The readable label is needed once per run, not once per fact row.
    return runs.select(*keys, "run", "start", "end", source_label("_first").alias("src"), "periods")


def provenance_text(src: DataFrame, keys: Sequence[str] = ("cik", "statement", "tag"),
                    max_lines: int | None = None) -> DataFrame:
    """(keys, n_runs, provenance): ``Source: x`` for one source, else one line a run.

    ``max_lines`` shortens the text to so many lines and ``+n more`` for display.
    """
    keys = list(keys)
    runs = source_runs(src, keys)
    start = F.date_format("start", "yyyy-MM-dd")
    end = F.date_format("end", "yyyy-MM-dd")
    line = F.when(F.col("start") == F.col("end"), F.concat(F.lit("- "), start, F.lit(": "), F.col("src"))) \
        .otherwise(F.concat(F.lit("- "), start, F.lit(" to "), end, F.lit(": "), F.col("src")))
    per = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sort_array(F.collect_list(F.struct(F.col("run"), line.alias("line")))).alias("_lines"),
        F.max_by("src", "start").alias("_newest"))
    shown = F.slice("_lines", 1, max_lines) if max_lines else F.col("_lines")
    lines = F.array_join(F.transform(shown, lambda x: x["line"]), "\n")
    left = F.col("n_runs") - (max_lines or 0)
    more = F.when(F.lit(bool(max_lines)) & (left > 0), F.concat(F.lit("\n- +"), left.cast("string"), F.lit(" more source runs"))).otherwise(F.lit(""))
    text = F.when(F.col("n_runs") == 1, F.concat(F.lit("Source: "), F.col("_newest"))) \
        .otherwise(F.concat(F.lit("Sources by period:\n"), lines, more))
    return per.select(*keys, "n_runs", text.alias("provenance"))


def line_item_metadata(items: DataFrame, provenance: DataFrame, descriptions: DataFrame | None = None,
                       keys: Sequence[str] = ("cik", "statement", "tag")) -> DataFrame:
    """Label, description, growth descriptions and provenance per line item, with the
    reference's defaults when a description or provenance is missing."""
    keys = list(keys)
    base = items.select(*keys).distinct()
    if descriptions is not None:
        base = base.join(descriptions.select("tag", "description"), "tag", "left")
    else:
        base = base.withColumn("description", F.lit(None).cast("string"))
    desc_ok = F.col("description").isNotNull() & (F.trim(F.col("description")) != "")
    subject = F.when(desc_ok, F.col("description")).otherwise(humanize("tag"))
    out = base.join(provenance.select(*keys, "provenance"), keys, "left")
    return out.select(*keys, humanize("tag").alias("line_item"),
                      F.when(desc_ok, F.col("description")).otherwise(F.lit(NO_DESCRIPTION)).alias("description"),
                      F.concat(F.lit("Year-over-year growth for "), subject).alias("growth_yoy_description"),
                      F.concat(F.lit("Period-over-period growth for "), subject).alias("growth_pop_description"),
                      F.coalesce(F.col("provenance"), F.lit(NO_PROVENANCE)).alias("provenance"))
