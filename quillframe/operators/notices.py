"""Public notices: matching by terms, merging of publications, links, upsert and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillframe.functions.text import fold_terms, holds_term


def match(folded: Column, required: list[str], excluded: list[str]) -> tuple[Column, Column]:
    """(matched terms, excluding term). An excluded term, the first that occurs, comes before any required one."""
    out = F.coalesce(*(F.when(holds_term(folded, F.lit(t)), F.lit(t)) for t in excluded), F.lit(None).cast("string"))
    terms = F.array_compact(F.array(*(F.when(holds_term(folded, F.lit(t)), F.lit(t)) for t in required)))
    return F.when(out.isNull(), terms).otherwise(F.array().cast("array<string>")), out


def fingerprint(buyer: Column, deadline: Column) -> Column:
    """Folded buyer and calendar day of the deadline; null (never merged) if one is missing."""
    folded = fold_terms(F.coalesce(buyer, F.lit("")))
    return F.when((folded != "") & deadline.isNotNull(), F.concat(folded, F.lit("|"), F.date_format(deadline, "yyyy-MM-dd")))


def merge(notices: DataFrame, *, preferred: str, order: str = "source_id") -> DataFrame:
    """One row per tender: the preferred source's first publication is primary, the others are listed.

    notices: source, source_id, fingerprint, dce_url, automatable.
    """
    rank = F.struct((F.col("source") != preferred).cast("int").alias("r"), F.col(order).alias("o"), "source", "source_id", "dce_url")
    key = F.coalesce(F.col("fingerprint"), F.concat_ws("#", F.lit("own"), "source", F.col("source_id").cast("string")))
    linked = F.coalesce(F.col("dce_url"), F.lit("")) != ""
    grouped = notices.groupBy(key.alias("merge_key")).agg(
        F.min(rank).alias("first"),
        F.min(F.when(linked & F.col("automatable"), rank)).alias("automatic"),
        F.min(F.when(linked, rank)).alias("link"),
        (F.count("*") - 1).cast("int").alias("n_duplicates"),
    )
    best = F.coalesce(F.col("automatic.dce_url"), F.col("link.dce_url"))
    return grouped.select("merge_key", "first.source", "first.source_id", "n_duplicates", best.alias("best_url"))


def scan_report(matched: DataFrame, *, preferred: str, seen: dict[str, Column]) -> DataFrame:
    """One row: the counts ``seen`` over the matched notices, and merged tenders and their duplicates. The counts are
    observed in passing while the tenders are merged, so the notices are read once."""
    watch = Observation()
    merged = merge(matched.observe(watch, *(c.alias(n) for n, c in seen.items())), preferred=preferred)
    totals = merged.agg(F.count("*").alias("n_merged"), F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("n_duplicates")).first()
    found = watch.get | totals.asDict()
    names = [*seen, "n_merged", "n_duplicates"]
    return matched.sparkSession.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))


def retrieval_plan(url: Column, manual_hosts: list[str], platform_hosts: list[str]) -> Column:
    """captcha hosts are manual, then platform hosts, then direct archives; anything else is manual."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    within = lambda hosts: F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    return F.when(within(manual_hosts), "manual").when(within(platform_hosts), "platform").when(F.regexp_like(url, F.lit(r"(?i)\.(zip|7z|rar)(\?|$)")), "direct").otherwise("manual")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], editorial: list[str], protected: list[str]) -> DataFrame:
    """stored with fresh editorial columns; protected columns (status, retrieval) are never touched on known rows."""
    old = stored.select(*key, *(F.col(c).alias(f"_old_{c}") for c in editorial + protected), F.lit(True).alias("_was"))
    new = fresh.select(*key, *(F.col(c).alias(f"_new_{c}") for c in editorial + protected), F.lit(True).alias("_is"))
    both = old.join(new, key, "full")
    kept = [F.when(F.col("_is"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in editorial]
    safe = [F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c) for c in protected]
    return both.select(*key, *kept, *safe, F.col("_was").isNull().alias("is_new"))


def by_urgency(notices: DataFrame, now: Column, deadline: str, seen: str, tie: str, most: int = 200) -> DataFrame:
    """Upcoming deadlines first, nearest ahead; then unknown ones; then past ones; at most ``most``."""
    bucket = F.when(F.col(deadline).isNull(), 1).when(F.col(deadline) < now, 2).otherwise(0)
    return notices.withColumn("bucket", bucket).orderBy("bucket", F.asc_nulls_first(deadline), F.desc(seen), tie).limit(most)


def records(raw: DataFrame, source: str, *, id_key: str, title_key: str, published_key: str) -> DataFrame:
    """Notices of one source from its JSON records, an unreadable record as a row with an error. raw: record (JSON)."""
    at = lambda key: F.get_json_object("record", f"$.{key}")
    row = raw.select(F.lit(source).alias("source"), at(id_key).alias("source_id"), at(title_key).alias("title"), F.try_to_date(F.left(at(published_key), F.lit(10))).alias("published_at"), "record")
    return row.select("source", "source_id", "title", "published_at", F.when(F.col("source_id").isNull(), F.lit("no readable record")).alias("error"))


def all_sources(*sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notices, errors) of all sources, in their order of preference; one source's errors never take another's notices."""
    together = sources[0]
    for s in sources[1:]:
        together = together.unionByName(s, allowMissingColumns=True)
    return together.where("error IS NULL").drop("error"), together.where("error IS NOT NULL").groupBy("source", "error").agg(F.count("*").alias("n"))


def scan(stored: DataFrame, fresh: DataFrame, *, today: Column, days: int = 30, key: list[str], editorial: list[str], protected: list[str]) -> DataFrame:
    """One pass over what was published in the last ``days``: an upsert by key, so a second pass changes nothing."""
    return upsert(stored, fresh.where(F.col("published_at") >= F.date_sub(today, days)), key, editorial, protected)
