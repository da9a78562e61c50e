"""Figure-level evaluation of extractions: set algebra, statuses, gates, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as T

# What an honest refusal says, and the gates' limits.
WALL_WORDS = ("blocked by bot protection", "consent/cookie wall", "error fetching", "HTTP 4", "HTTP 5")
SERVED_WALL_WORDS = ("verify you are a human", "complete the captcha", "checking your browser")
REACH_FLOOR = 0.7
MAX_OMISSIONS, MAX_MINOR, MAX_TIMEOUTS, MAX_OTHER = 1, 3, 2, 1


def is_wall_report(out: Column) -> Column:
    return G.any_of(out, WALL_WORDS)


def shown_body(out: Column) -> Column:
    """What stands after the first line of dashes, or all."""
    at = F.position(F.lit("---"), out)
    return F.when(at > 0, F.substr(out, at + 3)).otherwise(out)


def figure_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(T.figures(text)))


def judge_content(items: DataFrame) -> DataFrame:
    """Rows (shown, oracle, full_copy, warned, walled, expect_warning, expect_silent) with their figures' sets and status."""
    on, seen = figure_set(F.col("oracle")), figure_set(F.col("shown"))
    rows = items.withColumn("oracle_figures", on).withColumn("shown_figures", seen)
    missing = F.array_except("oracle_figures", "shown_figures")
    rows = rows.withColumn("fabricated", F.array_except("shown_figures", "oracle_figures")).withColumn("missing", missing)
    rows = rows.withColumn("recovered", F.filter("missing", lambda m: F.coalesce(F.contains(F.col("full_copy"), m), F.lit(False))))
    truly = F.array_except("missing", "recovered")
    silent = F.when(~F.col("warned") & ~F.col("expect_silent"), truly).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("omitted", silent)
    total = F.size("oracle_figures")
    share = F.when(total > 0, F.size(F.array_intersect("oracle_figures", "shown_figures")) / total).otherwise(F.lit(1.0))
    status = (
        F.when(F.col("walled"), "walled")
        .when(F.size("fabricated") > 0, "FAIL")
        .when(F.col("expect_warning") & ~F.col("warned") & (F.size(truly) > 0), "FAIL")
        .when(F.col("expect_silent") & F.col("price_warning"), "FAIL")
        .when((F.size("omitted") > 0) & (share >= 0.5) & (F.size("omitted") <= 2), "minor-omission")
        .when(F.size("omitted") > 0, "FAIL")
        .when(F.col("warned"), F.when(F.size("missing") > 0, "warn-correct").otherwise("pass"))
        .otherwise("pass")
    )
    return rows.withColumn("retained", share).withColumn("status", status)


def judge_wall(out: Column) -> Column:
    served = G.any_of(F.lower(shown_body(out)), SERVED_WALL_WORDS)
    return F.when(is_wall_report(out) | F.contains(out, F.lit("app shell")), "walled").when(served, "FAIL").otherwise("pass")


def judge_consent(out: Column) -> Column:
    body = shown_body(out)
    return F.when(is_wall_report(out), "walled").when((F.length(body) < 600) & F.contains(F.lower(body), F.lit("cookie")), "FAIL").otherwise("pass")


def judge_shell(out: Column, documented_limit: Column) -> Column:
    n = F.length(F.trim(T.collapse(shown_body(out))))
    return F.when(F.contains(out, F.lit("app shell")), "walled").when(n > 400, "pass").when(documented_limit, "documented-limit").otherwise("FAIL")


def judge_json(out: Column) -> Column:
    """A pretty-printed object came back."""
    return F.when(F.contains(out, F.lit('"')) & F.contains(out, F.lit("{")), "pass").when(F.contains(out, F.lit('"full_name"')), "pass").otherwise("FAIL")


def judge_pdf(out: Column) -> Column:
    """Text came out of a PDF, and more than 500 characters of it."""
    read = F.contains(out, F.lit("via: pypdf"))
    return F.when(~read, F.when(is_wall_report(out), "unreachable").otherwise("FAIL")).when(F.length(shown_body(out)) > 500, "pass").otherwise("FAIL")


def judge_map(out: Column) -> Column:
    """Five lines at least that are URLs or paths."""
    lines = F.filter(F.split(out, "\n"), lambda x: F.trim(x).rlike("^(http|/)"))
    return F.when(F.size(lines) >= 5, "pass").otherwise("FAIL")


def judge_crawl(out: Column) -> Column:
    return F.when(F.lower(out).rlike("pages|crawl"), "pass").otherwise("FAIL")


def judge_search(out: Column) -> Column:
    """Results have addresses; an engine that gives none is a third party's wall."""
    return F.when(F.contains(out, F.lit("http")), "pass").otherwise("walled")


def judge_verb(category: Column, out: Column) -> Column:
    """Status of what a verb returned, by the item's category; null for a category with figures of its own."""
    checks = {"wall": judge_wall, "consent": judge_consent, "json": judge_json, "pdf": judge_pdf, "map": judge_map, "crawl": judge_crawl, "search": judge_search}
    return F.coalesce(*[F.when(category == name, F.coalesce(check(out), F.lit("FAIL"))) for name, check in checks.items()])


def burst_outcome(out: Column) -> Column:
    return F.when(is_wall_report(out), "honest_refusal").when(F.length(F.trim(T.collapse(shown_body(out)))) > 100, "ok").otherwise("FAIL")


def verdict(results: DataFrame, *, poison: Column | None = None, exceptions: Column | None = None, drift: Column | None = None) -> DataFrame:
    """One row with the gates' counts and GREEN, YELLOW, RED or NO VERDICT."""
    no = F.lit(False)
    fail = F.col("status") == "FAIL"
    fabricated, omitted = F.size("fabricated") > 0, F.size("omitted") > 0
    calibration = fail & ~fabricated & ((F.col("expect_warning") & ~F.col("warned") & (F.size(F.array_except("missing", "recovered")) > 0)) | (F.col("expect_silent") & F.col("price_warning")))
    counts = results.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(~F.col("status").isin("unreachable", "timeout")).alias("reached"),
        F.count_if(fabricated).alias("fabrications"),
        F.count_if(calibration).alias("calibration"),
        F.count_if(omitted & fail).alias("omissions"),
        F.count_if(F.col("status") == "minor-omission").alias("minor"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(fail & ~fabricated & ~omitted).alias("other_failures"),
        F.count_if(poison if poison is not None else no).alias("poisoned"),
        F.count_if(exceptions if exceptions is not None else no).alias("exceptions"),
        F.count_if(drift if drift is not None else no).alias("drifted"),
    )
    red = (F.col("fabrications") > 0) | (F.col("poisoned") > 0) | (F.col("calibration") > 0)
    green = (F.col("omissions") <= MAX_OMISSIONS) & (F.col("minor") <= MAX_MINOR) & (F.col("timeouts") <= MAX_TIMEOUTS) & (F.col("other_failures") <= MAX_OTHER) & (F.col("exceptions") == 0) & (F.col("drifted") == 0)
    few = F.col("reached") / F.greatest(F.lit(1), F.col("n_items")) < REACH_FLOOR
    return counts.withColumn("verdict", F.when(few, "NO VERDICT").when(red, "RED").when(green, "GREEN").otherwise("YELLOW"))


def drift(baseline: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Items whose figures are not those that were pinned; items never pinned do not count."""
    b = baseline.select(key, F.array_sort("figures").alias("_pinned"))
    return snapshot.join(b, key).where(F.array_sort("figures") != F.col("_pinned")).drop("_pinned")


#: Gates of a report: the count they read and the most that passes.
GATES = (("fabrications", 0), ("calibration", 0), ("omissions", MAX_OMISSIONS), ("minor", MAX_MINOR), ("poisoned", 0), ("timeouts", MAX_TIMEOUTS), ("other_failures", MAX_OTHER), ("exceptions", 0), ("drifted", 0))


def report(results: DataFrame, judged: DataFrame, heading: str, max_detail: int = 100) -> DataFrame:
    """``section, key, line`` of the written report, in the order of section and key.

    ``results`` has (id, category, status, detail), ``judged`` is the row of ``verdict``.
    Details end after ``max_detail`` characters; a null is empty.
    """
    bold = lambda ok, good: F.when(ok, good).otherwise(F.lit("**FAIL**"))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x, F.lit("")) for x in c]), F.lit(" |"))
    gate = F.explode(F.array(*[F.struct(F.lit(f"{i:02d}").alias("key"), F.lit(n).alias("name"), F.col(n).alias("n"), F.lit(most).alias("most")) for i, (n, most) in enumerate(GATES)]))
    head = judged.select(F.explode(F.array(
        *[F.struct(F.lit(i).alias("section"), F.lit("").alias("key"), line.alias("line")) for i, line in enumerate((
            F.lit(f"# {heading}"), F.concat(F.lit("**VERDICT: "), F.col("verdict"), F.lit("**")), F.concat(F.lit("- "), F.col("n_items").cast("string"), F.lit(" items scored")),
            F.lit("## Gates"), F.lit("| gate | status | detail |"), F.lit("|---|---|---|")))],
        *[F.struct(F.lit(i).alias("section"), F.lit("").alias("key"), F.lit(line).alias("line")) for i, line in ((7, "## Items"), (8, "| id | category | status | detail |"), (9, "|---|---|---|---|"))],
    )).alias("r")).select("r.*")
    detail = F.concat(F.col("g.n").cast("string"), F.lit(" (at most "), F.col("g.most").cast("string"), F.lit(")"))
    gates = judged.select(gate.alias("g")).select(F.lit(6).alias("section"), F.col("g.key").alias("key"), cells(F.col("g.name"), bold(F.col("g.n") <= F.col("g.most"), F.lit("PASS")), detail).alias("line"))
    key = F.col("id").cast("string")
    items = results.select(F.lit(10).alias("section"), key.alias("key"), cells(key, F.col("category"), bold(F.col("status") != "FAIL", F.col("status")), F.substring("detail", 1, max_detail)).alias("line"))
    return head.unionByName(gates).unionByName(items)
