"""Analytics over a table of jobs (id, kind, payload, status, priority, run_at, attempts, max_attempts), and over run metrics and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.sources.scratch import placed


def queued_once(jobs: DataFrame) -> DataFrame:
    """Queued jobs without those whose kind and payload an earlier queued one has."""
    return jobs.where("status = 'queued'").groupBy("kind", "payload").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("suppressed"))


def ready_order(jobs: DataFrame, now: Column, kinds: list[str] | None = None) -> DataFrame:
    """(id, kind, place): every ready job in the order in which its kind may be run: higher priority first, then earlier, then id."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("run_at") <= now))
    if kinds is not None:
        ready = ready.where(F.col("kind").isin(kinds))
    return placed(ready.select("id", "kind", "priority", "run_at"), "kind", F.col("priority").desc(), F.col("run_at"), F.col("id")).select("id", "kind", "place")


def retry_schedule(jobs: DataFrame) -> DataFrame:
    """Failed jobs (with `permanent`: trying again can't help): wait of 5 s times 4 for each attempt after the first, 10 minutes at most; `failed` for good if permanent, the attempts are spent or a twin is queued."""
    twin = jobs.where("status = 'queued'").select("kind", "payload").distinct().withColumn("twin", F.lit(True))
    rows = jobs.where("status = 'failed'").join(twin, ["kind", "payload"], "left")
    final = F.coalesce("permanent", F.lit(False)) | (F.col("attempts") >= F.col("max_attempts")) | F.col("twin").isNotNull()
    wait = F.least(F.lit(600), (5 * F.pow(F.lit(4), F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(9)))).cast("int"))
    return rows.select("id", F.when(final, "failed").otherwise("queued").alias("next_status"), F.when(~final, wait).alias("wait_s"))


def stale_running(jobs: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Jobs that have run longer than the timeout: of each kind and payload, the oldest with attempts left is queued anew, unless such a job is queued already; the others fail."""
    old = jobs.where((F.col("status") == "running") & (F.timestamp_add("SECOND", F.lit(timeout_s), F.col("run_at")) < now))
    twin = jobs.where("status = 'queued'").select("kind", "payload").distinct().withColumn("twin", F.lit(True))
    first = F.min(F.when(F.col("attempts") < F.col("max_attempts"), F.col("id"))).over(Window.partitionBy("kind", "payload"))
    rows = old.withColumn("first", first).join(twin, ["kind", "payload"], "left")
    return rows.select("id", F.when((F.col("id") == F.col("first")) & F.col("twin").isNull(), "queued").otherwise("failed").alias("next_status"))


def latest(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind", "payload").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"))


def pending(jobs: DataFrame, runs: DataFrame, unranked: DataFrame, role_kinds: list[str], candidate_kinds: list[str]) -> DataFrame:
    """(role_id, state) of runs (role_id, embedded): what a run can do while embeddings are on their way.

    `wait` if the role has no embedding but a job of role_kinds is queued or running for it, `not_ready` if there is none; `partial` if such a job
    of candidate_kinds is on its way for one of those it couldn't rank (role_id, candidate_id), so that it hasn't seen everybody; else `whole`.
    """
    on_its_way = jobs.where(F.col("status").isin("queued", "running"))
    busy = lambda kinds, key: on_its_way.where(F.col("kind").isin(kinds)).select(F.col("payload").alias(key)).distinct()
    role = busy(role_kinds, "role_id").withColumn("role_busy", F.lit(True))
    some = unranked.join(busy(candidate_kinds, "candidate_id"), "candidate_id").select("role_id").distinct().withColumn("some", F.lit(True))
    rows = runs.join(role, "role_id", "left").join(some, "role_id", "left")
    return rows.select("role_id", F.when(~F.col("embedded"), F.when(F.col("role_busy"), "wait").otherwise("not_ready")).when(F.col("some"), "partial").otherwise("whole").alias("state"))


def owned(completions: DataFrame, claims: DataFrame) -> DataFrame:
    """completions (job_id, worker, attempt, at) with counts: only that of the job's latest claim (job_id, worker, attempt) counts."""
    last = claims.groupBy("job_id").agg(F.max_by(F.struct("worker", "attempt"), F.col("attempt")).alias("c"))
    rows = completions.join(last, "job_id", "left")
    return rows.select("job_id", "worker", "attempt", F.coalesce((F.col("c.worker") == F.col("worker")) & (F.col("c.attempt") == F.col("attempt")), F.lit(False)).alias("counts"))


def cost(runs: DataFrame, prices: DataFrame, free: list[str], override: tuple[float, float] | None = None) -> DataFrame:
    """runs (provider, model, tokens_in, tokens_out, ...) with cost: tokens times the prices a million; 0 for free providers, the override's if given, null without a price; six decimals."""
    rows = runs.join(prices.select("model", "price_in", "price_out"), "model", "left")
    price = [F.when(F.col("provider").isin(free), 0.0).otherwise(F.lit(o) if override else F.col(c)) for c, o in zip(("price_in", "price_out"), override or (None, None), strict=True)]
    return rows.withColumn("cost", F.round((F.col("tokens_in") * price[0] + F.col("tokens_out") * price[1]) / 1e6, 6)).drop("price_in", "price_out")


def per_model(runs: DataFrame) -> DataFrame:
    """Figures per model over runs that called it (replays left out): averages, cost, and exact percentiles.

    Times are counted first, so that a percentile is read from (model, total_ms, n) rows and no task holds all runs of a model.
    """
    live = runs.where("llm_calls > 0")
    times = live.groupBy("model", "total_ms").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("candidates", "llm_calls", "tokens_in", "tokens_out", "cost", "rerank_ms")], F.count("cost").alias("priced"))
    n = F.sum("n")
    return times.groupBy("model").agg(
        n.alias("runs"),
        *[F.round(F.sum(c) / n, k).alias(f"avg_{c}") for c, k in (("candidates", 1), ("llm_calls", 1), ("tokens_in", 0), ("tokens_out", 0), ("rerank_ms", 0))],
        F.round(F.try_divide(F.sum("cost"), F.nullif(F.sum("priced"), F.lit(0))), 4).alias("avg_cost"),
        F.round(F.try_divide(F.sum("cost"), F.nullif(F.sum("candidates"), F.lit(0))), 4).alias("cost_per_candidate"),
        F.round(F.sum(F.col("total_ms") * F.col("n")) / n, 0).alias("avg_total_ms"),
        F.round(F.expr("percentile(total_ms, 0.5, n)"), 4).alias("p50_ms"),
        F.round(F.expr("percentile(total_ms, 0.95, n)"), 4).alias("p95_ms"),
    )


def latest_runs(runs: DataFrame, roles: DataFrame, most: int = 20) -> DataFrame:
    """The newest runs that have metrics (a JSON text), with the figures taken out of it and their role's title."""
    m = lambda path, kind: F.get_json_object("metrics", f"$.{path}").cast(kind)
    top = runs.where("metrics IS NOT NULL").orderBy(F.col("created_at").desc(), "run_id").limit(most)
    return top.join(roles.select("role_id", "title"), "role_id").select(
        F.date_format("created_at", "MM-dd HH:mm:ss").alias("run_at"), F.left("title", F.lit(28)).alias("role"),
        F.coalesce("attention_reason", "match_status", F.lit("-")).alias("outcome"), "request_id", m("total_ms", "int").alias("total_ms"),
        *[m(f"stage_ms.{s}", "int").alias(f"{s}_ms") for s in ("filter", "rerank")], m("candidates", "int").alias("reranked"),
        m("llm_calls", "int").alias("llm_calls"), m("cache_hits", "int").alias("cache_hits"), m("input_tokens", "int").alias("tokens_in"),
        m("estimated_cost_usd", "double").alias("cost_usd"), m("model", "string").alias("model"),
    )


def usage(batches: DataFrame) -> DataFrame:
    """(run_id, llm_calls, cache_hits, tokens_in, tokens_out, cost): sums over a run's batches; cost is null if any batch has none."""
    sums = [F.sum(c).alias(c) for c in ("llm_calls", "cache_hits", "tokens_in", "tokens_out")]
    return batches.groupBy("run_id").agg(*sums, F.when(~F.bool_or(F.col("cost").isNull()), F.round(F.sum("cost"), 6)).alias("cost"))


def call_counts(requests: DataFrame) -> DataFrame:
    """requests (completions, cache_hits, prompt, answer) with llm_calls (completions that no cache answered) and token estimates of four characters each, rounded up."""
    tokens = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")
    return requests.withColumns({"llm_calls": F.col("completions") - F.col("cache_hits"), "tokens_in": tokens("prompt"), "tokens_out": tokens("answer")}).drop("prompt", "answer")


def cache_effect(calls: DataFrame) -> DataFrame:
    """(kind, model, calls, hits, hit_rate) of calls (kind, model, hit)."""
    return calls.groupBy("kind", "model").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"))


#: Fixed value: what a request's id may look like.
REQUEST_ID = "^[A-Za-z0-9._:-]{1,64}$"


def request_trace(lines: DataFrame) -> DataFrame:
    """Lines (ts, service, request_id, job_id, duration, calls, tokens) of all services by valid request id: counts, sums, attempts of jobs."""
    return lines.where(F.col("request_id").rlike(REQUEST_ID)).groupBy("request_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("service") == "ai").alias("ai_lines"), F.round(F.sum("duration"), 4).alias("duration"),
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.count_distinct("job_id").alias("jobs"))


def request_path(lines: DataFrame) -> DataFrame:
    """(request_id, place, ts, service): every line of a valid request in order of time, a row each, however many there are."""
    ok = lines.where(F.col("request_id").rlike(REQUEST_ID)).select("request_id", "ts", "service")
    return placed(ok, "request_id", F.col("ts"), F.col("service"))
