"""Retrieval quality under perturbation, as one job per evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.functions.perturb import Perturbation, hash_unit, perturb, pick, resolve
from vernissage.operators.index import CellIndex, search_cells
from vernissage.operators.quantile import exact_percentile, null_safe_join
from vernissage.operators.sampling import sample_n, sample_rank
from vernissage.schema import SCALING_SIZES, SearchConfig
from vernissage.session import materialize

Search = Callable[[DataFrame], DataFrame]


def cell_search(index: CellIndex, config: SearchConfig = SearchConfig()) -> Search:
    """The index search as a pluggable function from queries to hits."""
    return lambda queries: search_cells(index, queries, config)


def eval_queries(
    sample: DataFrame,
    transform: str | list[str] = "random",
    registry: dict[str, Perturbation] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Every sampled item under every perturbation: (qid, transform, id, vec)."""
    names = F.array(*[F.lit(n) for n in resolve(transform, registry)])
    every = sample.select("id", "vec", F.explode(names).alias("transform"))
    return perturb(every, F.col("transform"), registry, seed).select(
        F.concat_ws("|", "transform", "id").alias("qid"), "transform", "id", "vec"
    )


def eval_detail(queries: DataFrame, search: Search) -> DataFrame:
    """One row per query with what came back and whether it is the item itself."""
    # without the vectors the queries cost nothing to list again
    hits = search(queries.select("qid", "vec"))
    return (
        queries.drop("vec")
        .join(hits, "qid")
        .withColumn("correct", F.col("label").eqNullSafe(F.col("id")))
    )


def eval_summary(detail: DataFrame, by: list[str]) -> DataFrame:
    """n, correct, accuracy % and fallback % per group, over the rows that were searched.

    With a ``latency_ms`` column also its mean and 95th percentile.
    """
    figures = [
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"),
        (100 * F.avg(F.col("correct").cast("double"))).alias("accuracy"),
        (100 * F.avg(F.col("fallback_used").cast("double"))).alias("fallbacks"),
    ]
    if "latency_ms" not in detail.columns:
        return detail.groupBy(*by).agg(*figures)
    keys = by or ["_all"]
    stored = materialize(detail.withColumn("_all", F.lit(1)).select(*keys, "correct", "fallback_used", "latency_ms"))
    basic = stored.groupBy(*keys).agg(*figures, F.avg("latency_ms").alias("avg_ms"))
    tail = exact_percentile(stored, keys, "latency_ms", 0.95, "p95_ms")
    return null_safe_join(basic, tail, keys, "left").drop("_all")


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and exact 95th percentile of a stored measure per group."""
    mean = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("avg_ms"))
    return null_safe_join(mean, exact_percentile(df, [by], value, 0.95, "p95_ms"), [by], "left")


def run_evaluation(
    items: DataFrame,
    search: Search,
    n: int = 100,
    transform: str | list[str] = "random",
    seed: int = 42,
    registry: dict[str, Perturbation] | None = None,
) -> DataFrame:
    """Summary per perturbation over a sample of stored items (``id``, ``vec``)."""
    sample = sample_n(items, n, seed)
    return eval_summary(eval_detail(eval_queries(sample, transform, registry, seed), search), ["transform"])


def live_detail(metadata: DataFrame, items: DataFrame, search: Search, n: int = 100, seed: int = 42) -> DataFrame:
    """A ranked sample of metadata ids, searched unchanged; ids without a stored item stay, as misses."""
    asked = materialize(sample_rank(metadata.select("id"), n, seed))
    found = items.join(asked, "id").select(F.col("id").alias("qid"), "vec")
    hits = search(found)
    return asked.join(hits.withColumnRenamed("qid", "id"), "id", "left").withColumn(
        "correct", F.coalesce(F.col("label") == F.col("id"), F.lit(False))
    )


def _requested(by: list[Column], detail: DataFrame) -> DataFrame:
    latency = F.col("latency_ms") if "latency_ms" in detail.columns else F.lit(None).cast("double")
    return detail.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"),
        F.coalesce(100 * F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_ms"),
    )


def live_summary(detail: DataFrame) -> DataFrame:
    """Accuracy over all requested items, failed fetches included; zeros if there were none."""
    return _requested([], detail)


def scaling_summary(detail: DataFrame, sizes: tuple[int, ...] = SCALING_SIZES) -> DataFrame:
    """The live summary for growing samples, from one search of the largest."""
    wanted = F.array(*[F.lit(s) for s in sizes])
    grown = detail.withColumn("size", F.explode(F.filter(wanted, lambda s: s >= F.col("rank"))))
    return _requested([F.col("size")], grown)


def stress_detail(
    metadata: DataFrame, items: DataFrame, search: Search, names: list[str], n: int = 10, seed: int = 42
) -> DataFrame:
    """One random perturbation per sampled item; ids without a stored item stay, as misses."""
    asked = materialize(
        sample_n(metadata.select("id"), n, seed).withColumn(
            "scenario", pick(hash_unit(seed, "scenario", F.col("id")), names)
        )
    )
    changed = perturb(items.join(asked, "id"), F.col("scenario"), seed=seed)
    hits = search(changed.select(F.col("id").alias("qid"), "vec"))
    return asked.join(hits.withColumnRenamed("qid", "id"), "id", "left").withColumn(
        "correct", F.coalesce(F.col("label") == F.col("id"), F.lit(False))
    )


def stress_summary(detail: DataFrame) -> DataFrame:
    """Survival rate and mean latency per scenario, and of all scenarios together under ``overall``."""
    every = F.explode(F.array(F.col("scenario"), F.lit("overall")))
    return _requested([F.col("scenario")], detail.withColumn("scenario", every))


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, halves rounded away from zero."""
    scaled = F.floor(F.abs(value) * float(10**digits) + 0.5).cast("long")
    whole = F.floor(scaled / 10**digits).cast("long")
    rest = F.pmod(scaled, F.lit(10**digits)).cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(rest, digits, "0"))


def detail_lines(detail: DataFrame, n: int = -1) -> DataFrame:
    """Per-query lines: status, description and file name; the first ``n`` and every failure, or all for -1."""
    status = F.when(F.col("correct"), "MATCH").otherwise("FAIL")
    place = F.lpad(F.col("rank").cast("string"), 3, "0")
    place = F.when(F.col("rank") > 999, F.col("rank").cast("string")).otherwise(place)
    title = F.concat(
        F.lit("["), place, F.lit("] "), status, F.lit("  |  "), F.col("id"), F.lit("  →  "), F.col("label"),
        F.lit("  conf="), fixed(F.col("confidence") * 100, 2), F.lit("%"),
    )
    shown = detail if n < 0 else detail.filter((F.col("rank") <= n) | ~F.col("correct"))
    return shown.select(
        "transform", "rank", status.alias("status"), "id", "label", "confidence", title.alias("title"),
        F.concat_ws("_", place, F.lower(status), "id").alias("file_name"),
    )


def _row_line(columns: tuple[tuple[str, int, str], ...]) -> Column:
    parts = [F.lit("  "), F.rpad("transform", 12, " ")]
    for column, digits, unit in columns:
        parts += [F.lpad(fixed(F.col(column), digits), 13, " "), F.lit(unit)]
    return F.concat(*parts)


def report_lines(summary: DataFrame, stored: DataFrame) -> DataFrame:
    """The report as (n, line): a block for one perturbation, else a table with a row for each.

    ``summary`` has a row per ``transform``; ``stored`` is the row of ``index_stats``. Fixed layout: a rule of 56 signs
    above and below, names of 12 and figures of 13 characters.
    """
    rule = "=" * 56
    if summary.count() == 1:
        images = F.format_number(F.lit(stored.first()["n_images"]), 0)
        figures = (
            ("Transform:", F.col("transform")),
            ("Vault size:", F.concat(images, F.lit(" images"))),
            ("Evaluated:", F.concat(F.col("n").cast("string"), F.lit(" samples"))),
            ("Accuracy:", F.concat(F.col("correct"), F.lit("/"), F.col("n"), F.lit("  ("), fixed(F.col("accuracy"), 2), F.lit("%)"))),
            ("Fallbacks used:", F.concat(fixed(F.col("fallbacks"), 1), F.lit("%"))),
            ("Avg latency:", F.concat(fixed(F.col("avg_ms"), 2), F.lit(" ms"))),
            ("p95 latency:", F.concat(fixed(F.col("p95_ms"), 2), F.lit(" ms"))),
        )
        lines = [F.lit(rule), *[F.concat(F.lit(f"  {name:<19}"), value) for name, value in figures], F.lit(rule)]
        return summary.select(F.posexplode(F.array(*lines)).alias("n", "line"))
    titles = ("Accuracy", "Fallback%", "Avg ms", "p95 ms")
    header = f"  {'Transform':<12}" + "".join(f"{title:>13}" for title in titles)
    rows = summary.select("transform", _row_line((("accuracy", 1, "%"), ("fallbacks", 1, "%"), ("avg_ms", 2, ""), ("p95_ms", 2, ""))).alias("line"))
    place = F.row_number().over(Window.orderBy("transform"))  # a row per perturbation
    rows = rows.select((place + 2).alias("n"), "line")
    fixed_lines = [(0, rule), (1, header), (2, "  " + "-" * 64), (summary.count() + 3, rule)]
    return rows.unionByName(summary.sparkSession.createDataFrame(fixed_lines, "n int, line string"))


def write_report(summary: DataFrame, path: str, stored: DataFrame) -> None:
    """Write the summary rows as CSV and the report as text, line by line."""
    rows = materialize(summary)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary_csv")
    lines = report_lines(rows, stored).coalesce(1).sortWithinPartitions("n")
    lines.select("line").write.mode("overwrite").text(f"{path}/summary_text")
