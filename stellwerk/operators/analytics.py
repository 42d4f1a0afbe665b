"""Evaluations of stored tables that the design documents specify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk import constants as K
from stellwerk.functions.text import percent


def exclude_by_keyword(jobs: DataFrame, keywords: list[str], text: Column) -> DataFrame:
    """Add ``excluded_by``: the first keyword found in the text, NULL to keep the job."""
    lowered = F.lower(text)
    hits = F.array(*[F.when(lowered.contains(k.lower()), F.lit(k)) for k in keywords])
    return jobs.withColumn(
        "excluded_by", F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))
    )


def weighted_total(weights: dict[str, int] | None = None) -> Column:
    """Weighted mean of the five evaluation dimensions, one column each."""
    weights = weights or K.DIMENSION_WEIGHTS
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return F.round(total / sum(weights.values()), 4)


def strategy_comparison(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("eval_strategy").agg(
        F.count("*").alias("decisions"),
        F.round(F.avg("score_delta"), 4).alias("mean_delta"),
        F.round(F.stddev_samp("score_delta"), 4).alias("stddev_delta"),
    )


def detect_changes(jobs: DataFrame, texts: DataFrame, as_of: Column) -> DataFrame:
    """Compare text hashes with a new crawl (id, text) and append to the history."""
    fresh = texts.select("id", F.sha2("text", 256).alias("fresh_hash"))
    joined = jobs.join(fresh, "id", "left")
    changed = F.col("fresh_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("fresh_hash"))
    entry = F.struct(as_of.alias("changed_at"), F.col("content_hash").alias("content_hash"))
    kind = "array<struct<changed_at:timestamp,content_hash:string>>"
    history = F.coalesce(F.col("change_history").cast(kind), F.array().cast(kind))
    return joined.select(
        *[c for c in jobs.columns if c not in ("content_hash", "change_history")],
        F.coalesce("fresh_hash", "content_hash").alias("content_hash"),
        F.when(changed & F.col("content_hash").isNotNull(), F.array_append(history, entry))
        .otherwise(history)
        .alias("change_history"),
        changed.alias("changed"),
    )


def needs_reevaluation(jobs: DataFrame, users: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Evaluated (job, user) pairs whose profile has moved on since."""
    current = users.select("user_id", "profile_version")
    stale = evaluations.select("job_id", "user_id", F.col("profile_version").alias("used"))
    latest = stale.groupBy("job_id", "user_id").agg(F.max("used").alias("used"))
    return (
        latest.join(current, "user_id")
        .where(F.col("used") < F.col("profile_version"))
        .join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        .select("job_id", "user_id")
    )


def skill_trends(skills: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs, mean minimum salary and links per source for each skill and month."""
    dated = jobs.select(
        F.col("id").alias("job_id"), F.trunc("first_seen_at", "MM").alias("period_start"), "salary_min"
    )
    used = skills.select("job_id", "skill").distinct().join(dated, "job_id")
    sums = used.groupBy("skill", "period_start").agg(
        F.count("*").alias("job_count"), F.round(F.avg("salary_min"), 2).alias("avg_salary_min")
    )
    per_source = (
        used.select("job_id", "skill", "period_start")
        .join(sources.select("job_id", "source_name"), "job_id")
        .groupBy("skill", "period_start", "source_name")
        .agg(F.count("*").alias("n"))
        .groupBy("skill", "period_start")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_name", "n")))).alias("source_mix"))
    )
    return sums.join(per_source, ["skill", "period_start"], "left")


def salary_histogram(jobs: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    return (
        jobs.where(F.col("salary_min").isNotNull())
        .groupBy(F.width_bucket("salary_min", F.lit(low), F.lit(high), F.lit(bins)).alias("bucket"))
        .agg(F.count("*").alias("jobs"))
    )


def remote_share(jobs: DataFrame) -> DataFrame:
    counts = jobs.groupBy("sector").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("work_model") == "remote").alias("remote")
    )
    return counts.withColumn("remote_pct", percent(F.col("remote"), F.col("jobs")))


def application_funnel(jobs: DataFrame) -> DataFrame:
    """Found, applied, interviewed, offered: each stage includes the later ones."""
    status = F.col("status")
    return jobs.agg(
        F.count("*").alias("found"),
        F.count_if(status.isin("applied", "interview", "offer")).alias("applied"),
        F.count_if(status.isin("interview", "offer")).alias("interview"),
        F.count_if(status == "offer").alias("offer"),
    )


def best_sources(sources: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score per source over its distinct jobs."""
    pairs = sources.select("source_name", "job_id").distinct()
    return (
        pairs.join(scores.select("job_id", "score"), "job_id")
        .groupBy("source_name")
        .agg(F.count("*").alias("jobs"), F.round(F.avg("score"), 4).alias("mean_score"))
        .orderBy(F.desc("mean_score"), "source_name")
    )


def daily_tiles(jobs: DataFrame, as_of: Column) -> DataFrame:
    soon = (F.col("deadline") >= as_of) & (F.col("deadline") < as_of + F.make_dt_interval(days=F.lit(7)))
    return jobs.agg(
        F.count_if((F.col("status") == "new") & F.col("is_active")).alias("new"),
        F.count_if("is_active").alias("open"),
        F.count_if(F.col("is_active") & soon).alias("deadline_soon"),
        F.count_if(F.col("status") == "interview").alias("interviews"),
    )


def job_list(
    jobs: DataFrame, status: str | None = None, min_score: float | None = None,
    work_model: str | None = None, deadline_before: Column | None = None,
    text: str | None = None, order_by: str = "score", source: str | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Filtered, sorted list; filters left out do not apply.

    ``source`` keeps the jobs that one of the ``sources`` links names.
    """
    found = jobs
    if status is not None:
        found = found.where(F.col("status") == status)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    if work_model is not None:
        found = found.where(F.col("work_model") == work_model)
    if deadline_before is not None:
        found = found.where(F.col("deadline") < deadline_before)
    if text is not None:
        found = found.where(F.col("title").contains(text) | F.col("raw_text").contains(text))
    if source is not None:
        linked = sources.where(F.col("source_name") == source).select(F.col("job_id").alias("id"))
        found = found.join(linked, "id", "left_semi")
    return found.orderBy(F.desc_nulls_last(order_by), "id")


def clarification_queue(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Open issues of scored jobs; those with a score above 7 come first."""
    owners = companies.select(F.col("id").alias("company_id"), "address_status")
    joined = jobs.join(owners, "company_id", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("address_status") != "found", F.lit("company_address")),
            F.when(F.col("location_status") == "failed", F.lit("location")),
            F.when(F.col("work_model").isNull(), F.lit("work_model")),
        )
    )
    return joined.select(
        F.col("id").alias("entity_id"), F.explode(issues).alias("issue_type"), "score",
        F.when(F.col("score") > 7, "urgent").otherwise("normal").alias("priority"),
    ).orderBy(F.desc("priority"), F.desc_nulls_last("score"), "entity_id", "issue_type")


def anonymous_feedback(feedback: DataFrame, companies: DataFrame) -> DataFrame:
    """Feedback without reasoning; the company name becomes its sector category."""
    sectors = companies.select(F.col("id").alias("company_id"), "sector")
    return feedback.join(sectors, "company_id", "left").drop("reasoning", "company_name", "company_id")


def token_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model from token counts; models without a price cost nothing."""
    joined = usage.join(prices, "model", "left")
    cost = (
        F.col("input_tokens") / 1000 * F.coalesce("input_price", F.lit(0.0))
        + F.col("output_tokens") / 1000 * F.coalesce("output_price", F.lit(0.0))
    )
    return joined.groupBy("model").agg(F.round(F.sum(cost), 4).alias("cost"))


def location_fingerprint(title: Column, company: Column, location: Column) -> Column:
    """MD5 over lower-cased title, company and the first three words of the place."""
    from stellwerk.functions.text import collapse, strip

    words = F.array_join(F.slice(F.split(collapse(F.lower(location)), " "), 1, 3), " ")
    return F.md5(
        F.concat(strip(F.lower(title)), F.lit("|"), strip(F.lower(company)), F.lit("|"), words)
    )


def known_city(text: Column, cities: list[str]) -> Column:
    """First configured city named as a whole word, NULL if none."""
    from stellwerk.functions.text import extract

    return extract(text, r"(?U)\b(" + "|".join(cities) + r")\b")


def numeric_url_id(url: Column) -> Column:
    """Number of six or more digits between separators."""
    from stellwerk.functions.text import extract

    return extract(url, r"[-/](\d{6,})(?:[-/.?#]|$)")
