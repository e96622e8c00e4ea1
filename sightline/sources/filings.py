"""Nested filing payloads to long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT_TYPE = "struct<start:string,end:string,val:double,filed:string,form:string>"
FACTS_TYPE = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT_TYPE}>>>>>>"
EXIT_ITEMS = ("1.03", "2.01", "3.01", "5.01")


def company_facts(payloads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Company-facts JSON to long facts of the catalogue's concepts.

    ``payloads``: company, payload. ``catalogue``: tag, concept, place, kind
    ('duration' or 'instant'), money (bool); a settings-sized table. Durations
    need a start, instants forbid one, money units are three capital letters;
    equal facts keep the first tag in alias order.
    """
    parsed = payloads.select("company", F.from_json("payload", FACTS_TYPE).alias("p"))
    tags = parsed.select("company", F.explode("p.facts").alias("taxonomy", "tags")).select(
        "company", "taxonomy", F.explode("tags").alias("name", "body"))
    units = tags.select("company", F.concat_ws(":", "taxonomy", "name").alias("tag"), F.explode("body.units").alias("unit", "entries"))
    rows = units.join(F.broadcast(catalogue), "tag").select(
        "company", "tag", "unit", "concept", "place", "kind", "money", F.explode("entries").alias("e")).select(
        "company", "tag", "unit", "concept", "place", "kind", "money", "e.*")
    usable = (
        F.col("val").isNotNull() & F.when(F.col("kind") == "duration", F.col("start").isNotNull()).otherwise(F.col("start").isNull())
        & (~F.col("money") | F.col("unit").rlike("^[A-Z]{3}$"))
    )
    keys = ["company", "concept", "start", "end", "filed", "val", "unit"]
    return rows.where(usable).groupBy(*keys).agg(F.min_by(F.struct("tag", "form", "place"), "place").alias("x")).select(
        *keys, "x.tag", "x.form", F.col("x.place").alias("priority"))


def submission_rows(submissions: DataFrame) -> DataFrame:
    """Parallel arrays of form, date and items to filing rows; short arrays are padded with nulls."""
    return submissions.select("cik", F.explode(F.arrays_zip("form", "filed", "items")).alias("r")).select("cik", "r.*")


def exit_filings(rows: DataFrame, exit_forms: list[str]) -> DataFrame:
    """Exit forms, and 8-Ks only when they carry one of the exit items."""
    items = F.split(F.coalesce("items", F.lit("")), ",")
    relevant = F.size(F.array_intersect(items, F.array(*[F.lit(item) for item in EXIT_ITEMS]))) > 0
    return rows.where(F.col("form").isin(*exit_forms) | ((F.col("form") == "8-K") & relevant))


def latest_documents(documents: DataFrame) -> DataFrame:
    """One row per (url without trailing '/', hash): the last one listed (``sequence``)."""
    url = F.regexp_replace("url", "/+$", "")
    rest = [name for name in documents.columns if name not in ("url", "content_hash")]
    return documents.groupBy(url.alias("url"), "content_hash").agg(
        F.max_by(F.struct(*rest), "sequence").alias("x")).select("url", "content_hash", "x.*")
