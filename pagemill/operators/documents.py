"""Documents from page results: expected pages, gaps, roll-ups, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import texts
from pagemill.functions.numbers import ratio, rounded
from pagemill.params import Params

PAGE = ["document_id", "page_index"]
# Fixed value: the actor whose failed messages explain missing pages.
PAGE_ACTOR = "process_page_task"
# Pages are fanned out in blocks, so that no row carries an array as long as its document.
BLOCK = 4096


def page_numbers(documents: DataFrame, count: str = "num_pages", keep: list[str] | None = None) -> DataFrame:
    """One row per page 0..n-1 of each document; documents without pages give none.

    Long documents are cut into blocks that are spread over the cluster before they are expanded.
    """
    keep = keep or ["document_id"]
    blocks = documents.where(F.col(count) > 0).select(
        *keep, F.col(count).alias("total_pages"), F.explode(F.sequence(F.lit(0), F.expr(f"({count} - 1) div {BLOCK}"))).alias("_block"))
    spread = blocks.repartition(*keep, "_block")
    first = F.col("_block") * BLOCK
    last = F.least(first + BLOCK, F.col("total_pages")) - 1
    return spread.select(*keep, "total_pages", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("page_index"))


def named_pages(documents: DataFrame, path: str = "path", count: str = "num_pages") -> DataFrame:
    """Page fan-out with 1-based page names."""
    from pagemill.functions.names import page_name

    pages = page_numbers(documents, count, [path])
    number = F.col("page_index") + 1
    return pages.withColumns({"page_number": number, "page_name": page_name(F.col(path), number)})


def latest_results(results: DataFrame, keys: list[str] | None = None, version: list[str] | None = None) -> DataFrame:
    """Last write per (document, page). A reduction, not a window: repeats of one page combine before the shuffle."""
    keys, version = keys or PAGE, version or ["ts_us", "result_id"]
    rest = [c for c in results.columns if c not in keys]
    newest = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return newest.select(*keys, "_r.*")


def failed_pages(messages: DataFrame) -> DataFrame:
    """One explanation per (document, page) from parsed failed messages; the last in queue order counts."""
    work = messages.where((F.col("actor_name") == PAGE_ACTOR) & (F.size("args") > 2))
    keyed = work.select(
        F.get("args", F.lit(2)).alias("document_key"),
        F.get("args", F.lit(1)).try_cast("bigint").alias("page_index"),
        "message_id", "retries", "max_retries", "position",
    ).where("page_index IS NOT NULL")
    return latest_results(keyed, ["document_key", "page_index"], ["position"])


def decided_results(documents: DataFrame, results: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(documents with ``timeout_reached`` and ``processing_time``, their results as of the decision, one per page).

    A document is decided when every expected page has a result, or ``p.document_deadline_s`` after its first result
    (by ``ts_us``), whichever is first; what comes later does not count. A document without any result has reached its
    deadline. Only each row's own time counts, never the order in which rows arrive. The decision is made from the first
    time of each page, reduced before the shuffle; whole results move once, by page, and are sorted once, so a huge
    document is spread over its pages.
    """
    deadline = p.document_deadline_s * 1_000_000
    firsts = results.groupBy(*PAGE).agg(F.min("ts_us").alias("_at"))
    starts = firsts.groupBy("document_id").agg(F.min("_at").alias("first_us"))
    sizes = documents.select("document_id", "num_pages").distinct()
    timely = firsts.join(starts, "document_id").join(sizes, "document_id").where(
        (F.col("_at") <= F.col("first_us") + deadline) & F.col("page_index").between(0, F.col("num_pages") - 1)).select(*PAGE, "_at")
    reached = timely.groupBy("document_id").agg(F.count(F.lit(1)).alias("_pages"), F.max("_at").alias("_complete_us"))
    judged = documents.join(starts, "document_id", "left").join(reached, "document_id", "left")
    late = F.coalesce(F.col("_pages"), F.lit(0)) < F.col("num_pages")
    decided = F.when(late, F.col("first_us") + deadline).otherwise(F.coalesce("_complete_us", "first_us"))
    judged = judged.withColumns({"timeout_reached": late, "_decided_us": decided}).withColumn(
        "processing_time", rounded((F.col("_decided_us") - F.col("first_us")) / 1_000_000, 3))
    due = timely.join(judged.select("document_id", "_decided_us"), "document_id").where("_at <= _decided_us").drop("_at")
    counted = results.join(due, PAGE).where("ts_us <= _decided_us")
    return judged.drop("first_us", "_pages", "_complete_us", "_decided_us"), latest_results(counted.drop("_decided_us"))


def page_outcomes(documents: DataFrame, results: DataFrame, failed: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """One row per expected page: its result, or an error row that says why it is missing.

    ``results`` hold one row per page (see ``latest_results``); ``failed`` comes from ``failed_pages``. Documents may say by
    ``timeout_reached`` that they ran into their deadline (see ``decided_results``).
    All joins are on (document, page), so one huge document is spread like many small ones.
    """
    timed = ["timeout_reached"] if "timeout_reached" in documents.columns else []
    late = F.col("timeout_reached") if timed else F.lit(False)
    pages = page_numbers(documents, keep=["document_id", *timed])
    stored = results.select(*PAGE, "document_type", "confidence", "error", F.lit(True).alias("found"))
    joined = pages.join(stored, PAGE, "left").withColumn("missing", F.col("found").isNull()).drop("found")
    reason = F.when(late, F.format_string(texts.MISSING_TIMEOUT, F.lit(p.document_deadline_s))).otherwise(texts.MISSING_UNKNOWN)
    if failed is not None:
        # The key is brought to the type of the id, so that this join reuses the partitioning of the one before.
        key = F.col("document_key").try_cast(documents.schema["document_id"].dataType).alias("document_id")
        notes = failed.select(key, "page_index", "message_id", "retries", "max_retries", F.lit(True).alias("in_store"))
        joined = joined.join(notes, PAGE, "left")
        told = F.format_string(texts.MISSING_FAILED, "retries", "max_retries", "message_id")
        reason = F.when(F.col("in_store"), told).otherwise(reason)
    error = F.when(F.col("missing"), reason).otherwise(texts.explained_error(F.col("error")))
    outcome = joined.withColumns({
        "page_number": F.col("page_index") + 1,
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "error": error,
    })
    outcome = outcome.withColumn("summary", texts.page_summary(
        F.col("page_number"), F.col("document_type"), F.col("confidence"), F.col("error")))
    return outcome.select("document_id", "total_pages", "page_number", "page_index", "document_type", "confidence", "error", "missing", "summary")


COUNTS = ["document_id", "filename", "status", "total_pages", "successful_pages", "failed_pages", "missing_count", "success_rate"]


def _rolled_up(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """One aggregation over the pages, joined to the documents (some have no page)."""
    counted = outcomes.groupBy("document_id").agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("bad"),
        F.count_if("missing").alias("gaps"),
    )
    zero = F.lit(0).cast("bigint")
    known = documents.join(counted, "document_id", "left").withColumns(
        {"ok": F.coalesce("ok", zero), "bad": F.coalesce("bad", zero), "gaps": F.coalesce("gaps", zero)})
    return known.withColumns({
        "filename": F.coalesce("filename", F.concat(F.lit("document_"), F.col("document_id").cast("string"))),
        "status": texts.document_status(F.col("ok"), F.col("bad")),
        "total_pages": F.col("num_pages").cast("bigint"),
        "success_rate": success_rate(F.col("ok"), F.col("num_pages")),
    }).withColumnsRenamed({"ok": "successful_pages", "bad": "failed_pages", "gaps": "missing_count"})


def document_counts(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts, status and success rate per document; only counters are shuffled per document."""
    return _rolled_up(outcomes, documents).select(*COUNTS)


def success_rate(ok: Column, total: Column) -> Column:
    return rounded(ratio(ok, total) * 100, 2)


def seconds_per_page(seconds: Column, pages: Column) -> Column:
    return rounded(ratio(seconds, pages), 3)


def document_results(outcomes: DataFrame, documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The stored document record: counts, status, rate, ``timeout_reached``, ``processing_time`` and message.

    It is the same for documents of any size and holds no list: page results, summary lines and missing numbers are the
    rows of ``page_outcomes``, or the numbered blocks of ``document_blocks``. ``timeout_reached`` and ``processing_time``
    are taken from the documents (see ``decided_results``); without them they are false and null.
    """
    late = F.col("timeout_reached") if "timeout_reached" in documents.columns else F.lit(False)
    seconds = F.col("processing_time") if "processing_time" in documents.columns else F.lit(None).cast("double")
    full = _rolled_up(outcomes, documents).select(*COUNTS, late.alias("timeout_reached"), seconds.alias("processing_time"))
    return full.withColumn("message", texts.document_message(
        F.col("successful_pages"), F.col("failed_pages"), F.col("total_pages"), F.col("timeout_reached"), p.document_deadline_s))


def document_blocks(outcomes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Page results, summary lines, missing numbers and their text, in blocks of ``size`` consecutive pages numbered from 0.

    Documents of any size have the same form: a group is a block, so no row and no task holds more than ``size`` pages of one
    document. A document without pages has no block.
    """
    entry = F.struct("page_number", "document_type", "confidence", "error", "missing", "summary")
    blocks = outcomes.groupBy("document_id", F.expr(f"page_index div {size}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("_p"))
    gaps = F.transform(F.filter("_p", lambda r: r["missing"]), lambda r: r["page_number"])
    return blocks.withColumns({
        "missing_pages": gaps,
        "missing_list": texts.missing_list(gaps),
        "results_by_page": F.transform("_p", lambda r: F.struct(
            r["page_number"].alias("page_number"), r["document_type"].alias("document_type"),
            r["confidence"].alias("confidence"), r["error"].alias("error"))),
        "page_summary": F.transform("_p", lambda r: r["summary"]),
    }).drop("_p")


def with_filenames(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Original file name per document, ``document_{id}`` where it is unknown."""
    default = F.concat(F.lit("document_"), F.col("document_id").cast("string"))
    return documents.join(names, "document_id", "left").withColumn("filename", F.coalesce("filename", default))


def pages_from_maps(records: DataFrame) -> DataFrame:
    """``lines`` and ``errors`` maps (page to value) as one row per page; an error voids the lines."""
    lines = records.select("document_id", F.explode("lines").alias("page_index", "lines"))
    errors = records.select("document_id", F.explode("errors").alias("page_index", "error"))
    both = lines.join(errors, PAGE, "full_outer")
    kept = F.when(F.col("error").isNull() | (F.col("error") == ""), F.col("lines"))
    return both.select(*PAGE, kept.alias("lines"), "error")


def documents_without_pages(records: DataFrame) -> DataFrame:
    """Documents whose maps hold no page at all: rejected."""
    sizes = F.coalesce(F.size("lines"), F.lit(0)) + F.coalesce(F.size("errors"), F.lit(0))
    counted = records.groupBy("document_id").agg(F.sum(F.greatest(sizes, F.lit(0))).alias("pages"))
    return counted.where("pages = 0").select("document_id", F.lit("no page data").alias("problem"))


def page_ids(records: DataFrame) -> DataFrame:
    """All page ids with lines or errors, sorted."""
    lines = records.select("document_id", F.explode(F.map_keys("lines")).alias("page_index"))
    errors = records.select("document_id", F.explode(F.map_keys("errors")).alias("page_index"))
    return lines.union(errors).distinct().orderBy(*PAGE)


def batch_output(good: DataFrame, failures: DataFrame) -> DataFrame:
    """Successful rows followed by error records of the same columns."""
    return good.unionByName(failures, allowMissingColumns=True)
