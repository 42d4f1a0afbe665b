"""Explicit schemas (DDL) of the stored tables and of the shapes passed between operators."""

# One landed response.  ``search_key`` is what was asked for (a feed, a place, an
# id or a URL), ``page`` the order of the responses within one search.
LANDED = (
    "source_name string, search_key string, page bigint, fetched_at timestamp, payload string"
)

POSTING = (
    "seq bigint, source_name string, source_type string, title string, company_name string,"
    " url string, location_raw string, work_model string, published_at timestamp,"
    " deadline timestamp, salary_raw string, raw_text string, source_job_id string,"
    " sector string"
)

COMPANIES = (
    "id bigint, name string, name_normalized string, name_aliases array<string>,"
    " address_street string, address_city string, address_zip string, lat double, lng double,"
    " address_status string, address_source string, agent_findings array<string>,"
    " remote_policy string, careers_url string, ats_system string,"
    " created_at timestamp, updated_at timestamp"
)

TRANSIT_CACHE = (
    "company_id bigint, origin_hash string, transit_minutes int, api_used string,"
    " cached_at timestamp, expires_at timestamp"
)

JOBS = (
    "id bigint, canonical_id string, title string, company_id bigint, location_raw string,"
    " location_status string, work_model string, hybrid_days_hint int, salary_raw string,"
    " salary_min int, salary_max int, deadline timestamp, first_seen_at timestamp,"
    " last_seen_at timestamp, status string, is_active boolean, content_hash string,"
    " raw_text string, change_history array<struct<changed_at:timestamp,content_hash:string>>,"
    " created_at timestamp, updated_at timestamp, sector string"
)

JOB_SOURCES = (
    "id bigint, job_id bigint, url string, source_name string, source_type string,"
    " is_canonical boolean, first_seen_at timestamp, last_seen_at timestamp,"
    " last_checked_at timestamp, is_available boolean, content_hash string, source_job_id string"
)

RUN_STATS = "fetched:bigint,new:bigint,duplicate:bigint,skipped:bigint,errors:bigint,expired:bigint"

SCRAPE_RUNS = (
    "id bigint, started_at timestamp, finished_at timestamp, status string,"
    f" sources_run array<string>, stats struct<{RUN_STATS}>, error_log array<string>"
)

PARSED_LOCATION = (
    "raw string, city string, postal_code string, region string, pattern_type string,"
    " is_remote boolean"
)

LOCATION_SCORE = (
    "score double, effective_minutes int, transit_minutes_public int, transit_minutes_car int,"
    " work_model string, work_model_weight double, hybrid_days int, is_remote boolean"
)

COMPANY_ADDRESS = (
    "street string, city string, zip_code string, lat double, lng double, source string,"
    " status string"
)
