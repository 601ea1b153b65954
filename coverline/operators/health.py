"""State of feeds from the log of endpoint checks: latest rows, streaks and action lists."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions.columns import at, fnv1a, percent, since
from coverline.functions.components import components
from coverline.functions.urls import host_of, normalize_link
from coverline.sources.kept import keep

NEWEST = ("ran_at", "id")
#: So many tasks share the checks of one outlet, or the endpoints of one host.
SHARES = 16
#: Statuses that a repeat seldom cures.
PERMANENT = (401, 403, 404, 410, 451)


def latest(runs: DataFrame, keys: list[str], columns: list[str], condition: Column | None = None) -> DataFrame:
    """The newest row of each key, by one aggregate: no group is sorted."""
    rows = runs if condition is None else runs.where(condition)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*NEWEST)).alias("x")).select(*keys, "x.*")


def latest_runs(runs: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    return latest(runs, ["outlet_id", "method"], ["id", "source", "ran_at", "ok", "status_code", "error"], since("ran_at", as_of, minutes=minutes))


def health_state(attempts: Column, failures: Column, ok: Column) -> Column:
    pct = percent(failures, attempts)
    return F.when(ok.isNull(), "unknown").when(~ok & (pct >= 90) & (attempts > 0), "failing").when(~ok, "degraded").when(pct >= 30, "warning").otherwise("healthy")


def latest_health(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Per source the best method: its newest row of all time, and its attempts and failures of the last day."""
    newest = latest(runs, ["source", "method"], ["ran_at", "ok", "error"])
    recent = runs.where(since("ran_at", as_of, hours=24) & F.col("attempted")).groupBy("source", "method").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    both = newest.join(recent, ["source", "method"], "left").withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "failures": F.coalesce("failures", F.lit(0))})
    both = both.withColumn("health", health_state(F.col("attempts"), F.col("failures"), F.col("ok")))
    rank = F.array_position(F.array(*map(F.lit, ("healthy", "warning", "degraded", "failing", "unknown"))), F.col("health"))
    return both.groupBy("source").agg(F.min_by(F.struct("method", "ran_at", "ok", "error", "attempts", "failures", "health"), F.struct(rank, "method")).alias("x")).select("source", "x.*")


def failing_backoff(runs: DataFrame, as_of: datetime, minutes: int = 60, min_attempts: int = 4, min_fail_pct: int = 90) -> DataFrame:
    """Feeds to leave alone for a while: enough attempts in the window, nearly all of them failed."""
    rows = runs.where(since("ran_at", as_of, minutes=minutes) & F.col("attempted")).groupBy("outlet_id", "source", "method").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    return rows.withColumn("failure_pct", percent(F.col("failures"), F.col("attempts"))).where((F.col("attempts") >= min_attempts) & (F.col("failure_pct") >= min_fail_pct))


def failure_watchlist(runs: DataFrame, as_of: datetime, days: int = 30, min_attempts: int = 5, disable_fails: int = 20, disable_streak: int = 18, disable_rate: int = 90, watch_rate: int = 60) -> DataFrame:
    """Per outlet, method and endpoint in its normal form: failure rate, failures since the last success, commonest reason and status (of equal ones the newest), and what to do.

    The streak needs no sort: it counts the failures that are newer than the newest success.
    """
    rows = runs.where(since("ran_at", as_of, days=days) & F.col("attempted")).withColumn("url", F.coalesce(F.nullif(normalize_link(F.col("url")), F.lit("")), F.col("url")))
    keys = ["outlet_id", "method", "url"]
    last_ok = rows.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.struct(*NEWEST))).alias("last_ok"))
    per = rows.join(last_ok, keys).groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("fails"), F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.struct(*NEWEST) > F.col("last_ok")))).alias("streak"),
        F.max(F.when(~F.col("ok"), F.col("ran_at"))).alias("last_fail"), F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("last_success"), F.count_if(~F.col("ok") & F.col("status_code").isin(*PERMANENT)).alias("permanent"),
    )
    reasons = rows.where(~F.col("ok")).groupBy(*keys, "error").agg(F.count("*").alias("n"), F.max(F.struct(*NEWEST)).alias("newest"))
    top = reasons.groupBy(*keys).agg(F.max_by("error", F.struct("n", "newest")).alias("top_reason"))
    codes = rows.where(~F.col("ok") & F.col("status_code").isNotNull()).groupBy(*keys, "status_code").agg(F.count("*").alias("n"), F.max(F.struct(*NEWEST)).alias("newest"))
    top = top.join(codes.groupBy(*keys).agg(F.max_by("status_code", F.struct("n", "newest")).alias("top_status")), keys, "left")
    rate = percent(F.col("fails"), F.col("attempts"))
    hard = (F.col("last_success").isNull()) & (percent(F.col("permanent"), F.col("fails")) >= 80)
    action = F.when((F.col("fails") >= disable_fails) & (F.col("streak") >= disable_streak) & ((F.col("failure_pct") >= disable_rate) | hard), "DISABLE_CANDIDATE").when(F.col("failure_pct") >= watch_rate, "WATCH").otherwise("KEEP")
    kept = per.where(F.col("attempts") >= min_attempts).join(top, keys, "left").withColumn("failure_pct", rate)
    return kept.withColumn("action", action)


def feed_stability(rollup: DataFrame, min_attempts: int = 5) -> DataFrame:
    """Per outlet and method over the days of a rollup; ``zero_valid`` marks feeds that worked often enough and never brought an item."""
    per = rollup.groupBy("outlet_id", "method").agg(F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"), F.sum("fetched").alias("valid"))
    pct = percent(F.col("successes"), F.col("attempts"))
    state = F.when(F.col("attempts") < min_attempts, "no_data").when(F.coalesce("valid", F.lit(0)) == 0, "unstable").when(F.col("success_pct") >= 80, "stable").when(F.col("success_pct") >= 40, "warning").otherwise("unstable")
    zero = (F.col("method") == "rss") & (F.col("attempts") >= min_attempts) & (F.col("successes") > 0) & (F.coalesce("valid", F.lit(0)) == 0)
    return per.withColumn("success_pct", pct).withColumns({"stability": state, "zero_valid": zero})


def stale_watchlist(runs: DataFrame, exempt: DataFrame, as_of: datetime, high_value: Column, auto_days: int = 14, candidate_days: int = 7, watch_days: int = 3, safe_days: int = 30) -> DataFrame:
    """Per source the age of its newest item over the newest success of each method, what to do about it, and which may be switched off at once (``safe_disable``)."""
    newest = latest(runs, ["source", "method"], ["newest_item_published_at"], F.col("ok"))
    per = newest.groupBy("source").agg(F.max("newest_item_published_at").alias("newest_item"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
    days = F.datediff(at(as_of), "newest_item").cast("long")
    marked = per.join(exempt.select("source", F.lit(True).alias("is_exempt")), "source", "left").withColumn("stale_days", days)
    action = (
        F.when(F.col("newest_item") > at(as_of), "FUTURE_DATED_HOLD").when(F.col("is_exempt"), "EXEMPT_ARCHIVE").when(high_value & (F.col("stale_days") >= candidate_days), "HIGH_VALUE_STALE_HOLD")
        .when(F.col("stale_days") >= auto_days, "AUTO_DISABLE").when(F.col("stale_days") >= candidate_days, "DISABLE_CANDIDATE").when(F.col("stale_days") >= watch_days, "WATCH").otherwise("KEEP")
    )
    return marked.withColumn("action", action).drop("is_exempt").withColumn("safe_disable", (F.col("action") == "AUTO_DISABLE") & (F.col("stale_days") >= safe_days))


def auto_repair(runs: DataFrame, registry_urls: DataFrame) -> DataFrame:
    """For endpoints whose newest check failed: another endpoint of the same source whose newest check worked, and whether the swap is safe.

    The best is the newest, then the one that fetched most, then by URL; only failed URLs that the registry still has count.
    """
    newest = latest(runs, ["source", "method", "url"], ["ran_at", "ok", "fetched_count", "id"])
    failed = newest.where(~F.col("ok")).join(registry_urls.select("url").distinct(), "url", "left_semi").select("source", F.col("method").alias("failed_method"), F.col("url").alias("failed_url"))
    worked = newest.where("ok").select("source", "method", "url", "ran_at", "fetched_count")
    best = failed.join(worked, "source").where(F.col("url") != F.col("failed_url")).groupBy("source", "failed_method", "failed_url").agg(
        F.min_by(F.struct("method", "url"), F.struct(-F.unix_micros(F.col("ran_at").cast("timestamp")), -F.col("fetched_count"), "url")).alias("x")
    )
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^https?://(www\.)?", ""), r"(\?.*)?/*$", "")
    kind = F.when((F.col("failed_method") == "rss") & (F.col("x.method") == "sitemap"), "rss_to_sitemap").when(plain(F.col("failed_url")) == plain(F.col("x.url")), "canonical").otherwise("other")
    out = best.select("source", "failed_method", "failed_url", F.col("x.method").alias("method"), F.col("x.url").alias("url"), kind.alias("kind"))
    return out.withColumn("decision", F.when(F.col("kind") == "other", "REVIEW").otherwise("AUTO_APPLY"))


def hard_403_backlog(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Endpoints whose newest check was refused (403), against the newest success of the source; those that the registry has switched off are out."""
    newest = latest(runs, ["source", "outlet_id", "method", "url"], ["ran_at", "ok", "status_code"])
    refused = newest.where(F.col("status_code") == 403).join(registry.where(~F.col("enabled")).select("outlet_id"), "outlet_id", "left_anti")
    works = latest(runs, ["source"], ["url", "ran_at"], F.col("ok")).select("source", F.col("url").alias("works_url"), F.col("ran_at").alias("works_at"))
    action = F.when(F.col("works_url").isNull(), "find_replacement").when(F.col("works_url") == F.col("url"), "retry_later").when(F.col("works_at") > F.col("ran_at"), "use_working_url").otherwise("review")
    return refused.join(works, "source", "left").select("source", "outlet_id", "method", "url", "ran_at", "works_url", action.alias("action"))


def follow_ups(backlog: DataFrame, endpoints: DataFrame, redirects: DataFrame) -> DataFrame:
    """What to do about refused endpoints and repeated registrations: one row for each class of links of a country and method.

    ``backlog`` comes from ``hard_403_backlog``; ``endpoints`` has country, source, method, url and enabled, a row a registration;
    ``redirects`` from_url and to_url. Links are of one class if one leads to the other, if they agree without scheme, www, case of host,
    query and closing slash, or if a refused one has a working stand-in; classes follow such links over any number of steps.

    A refused class with a working link swaps to it (canonical_swap), unless an enabled registration has it already: then the refused
    ones are duplicates (disable_duplicate). Without a working link one is sought (find_replacement). A class that nobody
    refused but that has an enabled registration beside disabled ones loses these (remove_disabled). Other classes need nothing.
    """
    usable = backlog.where(F.col("action") == "use_working_url")
    listed = endpoints.select("url").unionByName(backlog.select("url")).unionByName(usable.select(F.col("works_url").alias("url"))).unionByName(redirects.select(F.col("from_url").alias("url"))).unionByName(redirects.select(F.col("to_url").alias("url"))).where("url is not null").distinct()
    plain = F.concat(F.regexp_replace(host_of(F.col("url")), "^www[.]", ""), F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", ""))
    # a link meets its plain form, which is a node as well, so that links of one form need no pairs
    links = listed.select(F.col("url").alias("a"), F.concat(F.lit("~"), plain).alias("b")).unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b"))).unionByName(usable.select(F.col("url").alias("a"), F.col("works_url").alias("b")))
    classes = components(links).where(~F.col("node").startswith("~")).select(F.col("node").alias("url"), F.col("class_id").alias("component"))
    names = classes.groupBy("component").agg(F.min("url").alias("class_url"))
    classes = keep(classes.join(names, "component").select("url", "class_url"), "classes")
    keys = ["country", "method", "class_url"]
    owners = endpoints.join(classes, "url").groupBy(*keys).agg(F.count_if("enabled").alias("n_enabled"), F.count_if(~F.col("enabled")).alias("n_disabled"))
    named = backlog.join(endpoints.select("source", "method", "url", "country").distinct(), ["source", "method", "url"]).join(classes, "url")
    refused = named.groupBy(*keys).agg(
        F.count("*").alias("n_refused"), F.max_by("url", F.struct("ran_at", "url")).alias("from_url"), F.max_by("works_url", F.when(F.col("action") == "use_working_url", F.struct("ran_at", "works_url"))).alias("to_url"),
    )
    enabled = endpoints.where("enabled").select("country", "method", F.col("url").alias("to_url")).distinct().withColumn("represented", F.lit(True))
    rows = owners.join(refused, keys, "full").join(enabled, ["country", "method", "to_url"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_enabled", "n_disabled", "n_refused")}
    swap = F.when(F.col("to_url").isNull(), "find_replacement").when(F.col("represented"), "disable_duplicate").otherwise("canonical_swap")
    action = F.when(F.col("n_refused") > 0, swap).when((F.col("n_enabled") > 0) & (F.col("n_disabled") > 0), "remove_disabled")
    return rows.withColumns(counts).withColumn("action", action).where("action is not null").select(*keys, "action", "n_enabled", "n_disabled", "n_refused", "from_url", "to_url")


def _per_host(rows: DataFrame, value: Column, key: str) -> DataFrame:
    """``rows`` with an aggregate of their host; a host's rows stay spread over tasks, in shares by ``key``, each of which meets a copy of it."""
    per = rows.groupBy("host").agg(value).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("share", F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int")).join(per, ["host", "share"], "left").drop("share")


def waf_triage(backlog: DataFrame) -> DataFrame:
    """Refused endpoints by how many share their host, and the queue they go to."""
    hosts = backlog.withColumn("host", host_of(F.col("url")))
    queue = F.when(F.col("host_n") >= 10, "host_family").when(F.col("host_n") >= 4, "host_group").when(F.col("action") == "use_working_url", "swap").when(F.col("method") == "sitemap", "sitemap_alone").otherwise("single")
    return _per_host(hosts, F.count("*").alias("host_n"), "url").withColumn("queue", queue).select("source", "outlet_id", "method", "url", "host", "host_n", "queue")


def head_risk(articles: DataFrame, runs: DataFrame, as_of: datetime, runs_as_of: datetime, min_created: int = 20) -> DataFrame:
    """Head sources whose busiest hour may hold more items than a feed shows at once.

    STRICT if the busiest hour reaches the least number fetched, ONE_MISS if two such hours do.
    """
    head = articles.where(since("created_at", as_of, hours=24)).groupBy("source").agg(F.count("*").alias("created_24h")).where(F.col("created_24h") >= min_created)
    hours = articles.where(since("publication_datetime", as_of, days=7)).groupBy("source", F.date_trunc("hour", "publication_datetime").alias("hour")).agg(F.count("*").alias("n"))
    peak = hours.groupBy("source").agg(F.max("n").alias("peak"))
    good = (F.col("method") == "rss") & F.col("ok") & (F.col("fetched_count") > 0)
    feeds = runs.where(since("ran_at", runs_as_of, days=7) & F.col("attempted")).groupBy("source").agg(
        F.min(F.when(good, F.col("fetched_count"))).alias("least_fetched"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY fetched_count) FILTER (WHERE method = 'rss' AND ok AND fetched_count > 0)").cast("long").alias("median_fetched"),
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.bool_and(F.col("method") == "rss").alias("rss_only"),
    )
    risk = F.when(F.col("peak") >= F.col("least_fetched"), "STRICT").when(2 * F.col("peak") >= F.col("least_fetched"), "ONE_MISS").otherwise("NONE")
    return head.join(peak, "source").join(feeds, "source").withColumn("risk", risk)


def scheduling_coverage(risks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source at risk: its other feeds, how many work, the newest check."""
    newest = latest(runs, ["source", "outlet_id", "method"], ["ran_at", "ok"])
    per = newest.groupBy("source").agg(F.count("*").alias("feeds"), F.count_if("ok").alias("working"), F.max("ran_at").alias("last_run"))
    state = F.when(F.coalesce("feeds", F.lit(0)) == 0, "no_feeds").when(F.col("working") == 0, "all_failing").when(F.col("working") == F.col("feeds"), "covered").otherwise("partly_covered")
    return risks.where("risk <> 'NONE'").select("source", "risk").join(per, "source", "left").withColumn("status", state)


def outlet_schedule(outlets: DataFrame, counts: DataFrame, hour: int, head_least: int = 10, head_top: int = 50, cold_slots: int = 6) -> DataFrame:
    """Which outlets a run takes: busy ones always, those with some items in the tail, the cold ones in turn by a stable hash."""
    rows = outlets.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = rows.where(F.col("n") >= head_least).orderBy(F.desc("n"), "outlet_id").limit(head_top).select("outlet_id", F.lit(True).alias("is_head"))
    out = rows.join(ranked, "outlet_id", "left")
    slot = (fnv1a(F.col("outlet_id").cast("string")) % cold_slots).cast("long")
    tier = F.when(F.col("is_head"), "head").when(F.col("n") > 0, "warm").when(slot == hour % cold_slots, "cold").otherwise("skipped")
    return out.select("outlet_id", "source", "n", slot.alias("slot"), tier.alias("tier"))


POLICY = "outlet_id long, status string, reason string, consecutive_failures long, last_status_code int, disabled_until timestamp_ntz, updated_at timestamp_ntz"
NEW_POLICY = {"status": "active", "reason": None, "consecutive_failures": 0, "last_status_code": None, "disabled_until": None, "updated_at": None}
#: Failures in a row that pause a sitemap, 404s in a row that end it, days of a pause and until an ended one is looked at again.
PAUSE_AFTER, GONE_AFTER, PAUSE_DAYS, RECHECK_DAYS = 2, 3, 7, 30


def failure_reason(status: Column, error: Column) -> Column:
    """What kind of failure a check met; null where neither status nor error tells."""
    text = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == 410, "http_410").when(status.isin(301, 308) | text.contains("permanent_moved") | text.contains("moved permanently"), "permanent_moved").when((status == 404) | (text == "http_404"), "http_404")
        .when(status.isin(403, 500, 502, 503, 504), F.concat(F.lit("http_"), status.cast("string"))).when(text.contains("timeout") | text.contains("timed out"), "timeout").when(text.contains("network_error") | text.contains("abort"), "network_error")
    )


def policy_rows(runs: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """The checks of sitemaps as the policy reads them: reason of a failure, and whether a twin of the outlet (``twins``: outlet_id) works."""
    rows = runs.where(F.col("attempted") & (F.col("method") == "sitemap"))
    rows = rows.select("outlet_id", "id", "ran_at", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("status_code").cast("int").alias("status_code"), failure_reason(F.col("status_code"), F.col("error")).alias("failure"))
    if twins is None:
        return rows.withColumn("twin", F.lit(False))
    return rows.join(twins.select("outlet_id", F.lit(True).alias("twin")).distinct(), "outlet_id", "left").withColumn("twin", F.coalesce("twin", F.lit(False)))


def living_twins(runs: DataFrame) -> DataFrame:
    """Outlets with another one of their source and country whose newest check of a sitemap worked."""
    newest = latest(runs.where(F.col("attempted") & (F.col("method") == "sitemap")), ["source", "country", "outlet_id"], ["ok"])
    alive = newest.groupBy("source", "country").agg(F.count_if(F.col("ok")).alias("n"))
    return newest.join(alive, ["source", "country"]).where(F.col("n") > F.when(F.col("ok"), 1).otherwise(0)).select("outlet_id")


def policy_step(state: dict, row) -> dict:
    """One check's effect on a sitemap's policy.

    A success resets it. What is gone or moved for good ends it, as does a 404 with a living twin or after ``GONE_AFTER``
    failures; any other known failure pauses it from the ``PAUSE_AFTER``-th on; an unknown one only counts, but begins a
    pause anew that had come to its end.
    """
    now = {**state, "consecutive_failures": state["consecutive_failures"] + 1, "updated_at": row.ran_at}
    now["last_status_code"] = None if row.status_code is None or row.status_code != row.status_code else int(row.status_code)
    if row.ok:
        return {**NEW_POLICY, "last_status_code": now["last_status_code"], "updated_at": row.ran_at}
    n = now["consecutive_failures"]
    if row.failure in ("http_410", "permanent_moved") or row.failure == "http_404" and (row.twin or n >= GONE_AFTER):
        return {**now, "status": "disabled_permanent", "reason": row.failure, "disabled_until": row.ran_at + pd.Timedelta(days=RECHECK_DAYS)}
    if isinstance(row.failure, str) and n >= PAUSE_AFTER:
        return {**now, "status": "disabled_temporary", "reason": row.failure, "disabled_until": row.ran_at + pd.Timedelta(days=PAUSE_DAYS)}
    if not isinstance(row.failure, str) and now["status"] != "active" and now["disabled_until"] <= row.ran_at:
        return {**now, "disabled_until": row.ran_at + pd.Timedelta(days=PAUSE_DAYS if now["status"] == "disabled_temporary" else RECHECK_DAYS)}
    return now


def sitemap_policy(runs: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """The policy of every outlet after all its sitemap checks, as policy_step folds them in order of time.

    Only failures after the newest success count, and the last one that decides anything holds the status. Whether a
    failure comes late enough needs its place in the streak only for the first ``GONE_AFTER`` failures: these are found as
    the smallest of the streak, without sorting it. Unknown failures after it may begin an elapsed pause anew, and then again:
    each round finds the first one past the pause of every outlet, so there are as many rounds as pauses in a row at most.
    """
    rows = policy_rows(runs, twins)
    newest = F.struct("ran_at", "id")
    # an outlet's checks stay spread over tasks: each share meets a copy of its one row
    shared = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    last_ok = rows.groupBy("outlet_id").agg(F.max(F.when(F.col("ok"), newest)).alias("last_ok"))
    marked = shared.join(last_ok.select("outlet_id", "last_ok", copies), ["outlet_id", "share"]).withColumn("failed", ~F.col("ok") & (F.col("last_ok").isNull() | (newest > F.col("last_ok"))))
    first = _smallest(marked.where("failed").select("outlet_id", "share", newest.alias("at")), GONE_AFTER)
    marked = marked.join(first.select("outlet_id", "places", copies), ["outlet_id", "share"], "left")
    place = lambda n: F.get(F.col("places"), n - 1).isNotNull() & (newest >= F.get(F.col("places"), n - 1))
    gone = F.col("failure").isin("http_410", "permanent_moved") | ((F.col("failure") == "http_404") & (F.col("twin") | place(GONE_AFTER)))
    decides = F.when(F.coalesce(gone, F.lit(False)), "disabled_permanent").when(F.col("failure").isNotNull() & place(PAUSE_AFTER), "disabled_temporary")
    marked = marked.withColumn("decides", F.when(F.col("failed"), decides))
    per = marked.groupBy("outlet_id").agg(
        F.count_if("failed").alias("failures"), F.max_by(F.struct("decides", "failure", "ran_at", "id"), F.when(F.col("decides").isNotNull(), newest)).alias("d"), F.max_by(F.struct("status_code", "ran_at"), newest).alias("x"),
    )
    until = F.when(F.col("d.decides") == "disabled_permanent", F.col("d.ran_at") + F.expr(f"INTERVAL '{RECHECK_DAYS}' DAY")).when(F.col("d.decides").isNotNull(), F.col("d.ran_at") + F.expr(f"INTERVAL '{PAUSE_DAYS}' DAY"))
    until = _renewed(per.select("outlet_id", F.col("d.decides").alias("decides"), until.alias("until"), F.struct("d.ran_at", "d.id").alias("decided")).where("until is not null"), marked.where(F.col("failed") & F.col("failure").isNull()).select("outlet_id", "share", newest.alias("at")))
    return per.join(until, "outlet_id", "left").select("outlet_id", F.coalesce("d.decides", F.lit("active")).alias("status"), F.when(F.col("d.decides").isNotNull(), F.col("d.failure")).alias("reason"), F.col("failures").alias("consecutive_failures"), F.col("x.status_code").alias("last_status_code"), F.col("until").alias("disabled_until"), F.col("x.ran_at").alias("updated_at"))


def _renewed(pauses: DataFrame, unknown: DataFrame) -> DataFrame:
    """(outlet_id, until): pauses (outlet_id, decides, until, decided) after the unknown failures (outlet_id, share, at) that came past their ends."""
    ends = keep(pauses, "pauses")
    later = keep(unknown.join(_copies(ends.select("outlet_id", "decided", F.col("until").alias("first_until"))), ["outlet_id", "share"]).where((F.col("at") > F.col("decided")) & (F.col("at.ran_at") >= F.col("first_until"))).select("outlet_id", "share", F.col("at.ran_at").alias("ran_at")), "unknown")
    days = F.when(F.col("decides") == "disabled_temporary", F.expr(f"INTERVAL '{PAUSE_DAYS}' DAY")).otherwise(F.expr(f"INTERVAL '{RECHECK_DAYS}' DAY"))
    while True:
        past = later.join(_copies(ends.select("outlet_id", "until")), ["outlet_id", "share"]).where("ran_at >= until").groupBy("outlet_id").agg(F.min("ran_at").alias("again"))
        past = keep(past, "again")
        if past.isEmpty():
            return ends.select("outlet_id", "until")
        ends = keep(ends.join(past, "outlet_id", "left").withColumn("until", F.when(F.col("again").isNotNull(), F.col("again") + days).otherwise(F.col("until"))).drop("again"), "pauses")


def _copies(outlets: DataFrame) -> DataFrame:
    """Each outlet's row for each share of its checks."""
    return outlets.select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """(outlet_id, places): the n smallest of each outlet, in order, by minima alone: each round looks past the one before."""
    left, found = rows, None
    for k in range(n):
        low = left.groupBy("outlet_id").agg(F.min("at").alias(f"p{k}"))
        found = low if found is None else found.join(low, "outlet_id", "left")
        copies = low.select("outlet_id", f"p{k}", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        left = left.join(copies, ["outlet_id", "share"]).where(F.col("at") > F.col(f"p{k}")).select("outlet_id", "share", "at")
    return found.select("outlet_id", F.array(*(f"p{k}" for k in range(n))).alias("places"))


#: Hours until a rate-limited endpoint without a date is tried again, and days between reviews.
LIMITED_HOURS, REVIEW_DAYS = 6, 7


def recovery_plan(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Per endpoint that fails now: cause, action, whether a person must look, and when to try again; a host waits for its last endpoint.

    What may pass is tried after an hour doubled with each failure, at most 7 days; what a person must look at after
    ``REVIEW_DAYS``; a rate limit holds until the time the host gave (``retry_after_at``, where the log has it) but a minute
    at least, else ``LIMITED_HOURS``.
    """
    keys = ["outlet_id", "method", "url"]
    rows = runs if "retry_after_at" in runs.columns else runs.withColumn("retry_after_at", F.lit(None).cast("timestamp_ntz"))
    last_ok = rows.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.struct(*NEWEST))).alias("last_ok"))
    since_ok = rows.join(last_ok, keys).where(~F.col("ok") & F.col("attempted") & (F.col("last_ok").isNull() | (F.struct(*NEWEST) > F.col("last_ok"))))
    per = since_ok.groupBy(*keys).agg(F.count("*").alias("failures"), F.max_by(F.struct("status_code", "error", "retry_after_at", "ran_at"), F.struct(*NEWEST)).alias("x")).select(*keys, "failures", "x.*")
    status, text = F.col("status_code"), F.lower(F.coalesce("error", F.lit("")))
    category = (
        F.when(status == 429, "rate_limited").when(status.isin(401, 402, 403, 451), "access_restricted").when(status.isin(404, 410), "missing_endpoint").when(status.between(500, 599), "server_error")
        .when(text.contains("timeout") | text.contains("timed out") | text.contains("reset") | text.contains("refused"), "transport").when(status.isNotNull(), "other_http").otherwise("unresolved")
    )
    action = F.when(F.col("category") == "rate_limited", "wait_retry_after").when(F.col("category") == "access_restricted", "review_access").when(F.col("category") == "missing_endpoint", "review_replacement").when(F.col("category").isin("server_error", "transport"), "bounded_backoff").otherwise("review_response")
    review = F.col("action").startswith("review")
    backoff = F.expr("make_dt_interval(0, cast(least(pow(2, least(greatest(failures, 1), 8)), 168) as int))")
    day = lambda n: F.expr(f"INTERVAL '{n}' DAY")
    told = F.greatest(F.col("retry_after_at"), F.col("ran_at") + F.expr("INTERVAL '1' MINUTE"))
    limited = F.when(F.col("retry_after_at").isNull(), F.col("ran_at") + F.expr(f"INTERVAL '{LIMITED_HOURS}' HOUR")).otherwise(told)
    retry = F.when(F.col("category") == "rate_limited", limited).when(F.col("category") == "unresolved", F.col("ran_at") + day(1)).when(review, F.col("ran_at") + day(REVIEW_DAYS)).otherwise(F.col("ran_at") + backoff)
    out = per.withColumn("category", category).withColumn("action", action).withColumns({"review": review, "host": host_of(F.col("url")), "retry_at": retry})
    return _per_host(out.select(*keys, "failures", "status_code", "ran_at", "category", "action", "review", "host", "retry_at"), F.max("retry_at").alias("host_until"), "outlet_id")


def latest_profiles(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per person the primary account with its newest snapshot (those without a time are oldest, then by id)."""
    primary = accounts.groupBy("person_id").agg(F.max_by(F.struct(F.col("id").alias("account_id"), "platform", "handle"), F.struct(F.col("is_primary"), -F.col("id"))).alias("x")).select("person_id", "x.*")
    newest = snapshots.groupBy(F.col("social_account_id").alias("account_id")).agg(F.max_by(F.struct("followers_count", "snapshot_at"), F.struct(F.coalesce("snapshot_at", F.lit("0001-01-01").cast("timestamp_ntz")), "id")).alias("y"))
    return primary.join(newest, "account_id", "left").select("person_id", "account_id", "platform", "handle", "y.followers_count", "y.snapshot_at")


def social_upsert(existing: DataFrame, rows: DataFrame, keys: list[str], keep_old: list[str], new_wins: list[str]) -> DataFrame:
    """Full outer join by key: new counts win where the row is new, null media keep the old, metadata maps merge with the right one winning."""
    e = existing.select(*keys, F.lit(True).alias("__old"), *(F.col(c).alias(f"old_{c}") for c in [*keep_old, *new_wins, "metadata"]))
    n = rows.select(*keys, F.lit(True).alias("__new"), *keep_old, *new_wins, "metadata")
    both = e.join(n, keys, "full")
    empty = F.create_map().cast("map<string,string>")
    kept = lambda c: F.map_filter(F.coalesce(F.col("old_metadata"), empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(F.col("metadata"), empty)), k))
    merged = F.map_concat(kept(None), F.coalesce(F.col("metadata"), empty))
    flag = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *(F.coalesce(c, f"old_{c}").alias(c) for c in keep_old), *(F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in new_wins), merged.alias("metadata"), flag.alias("change"))


def freshness_state(age_days: Column, monitor: int = 30, stale: int = 90) -> Column:
    return F.when(age_days.isNull(), "unknown").when(age_days < monitor, "fresh").when(age_days < stale, "monitor").otherwise("stale")
