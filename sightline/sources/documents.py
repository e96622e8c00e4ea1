"""Text and filing-index reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.sources.universe import allowed_url

# Terms that make a claim material.
MATERIAL_TERMS = ("adverse", "bankruptcy", "clinical", "covenant", "debt", "dilution", "financing", "fraud", "guidance",
                  "investigation", "lawsuit", "loss", "merger", "regulatory", "revenue", "trial")


def other_listed(rows: DataFrame) -> DataFrame:
    """US listings from pipe-delimited lines: symbol|name|exchange|etf|test; tests and ETFs dropped."""
    parts = F.split("line", r"\|")
    named = rows.select(*[parts[i].alias(n) for i, n in enumerate(("ticker", "company_name", "code", "etf", "test"))])
    codes = F.create_map(*[F.lit(x) for pair in C.EXCHANGE_CODES.items() for x in pair])
    return named.where((F.col("test") == "N") & (F.col("etf") == "N") & (F.col("ticker") != "")).select(
        "ticker", "company_name", F.coalesce(F.try_element_at(codes, F.col("code")), F.col("code")).alias("exchange"),
        F.lit("US").alias("country"), F.lit("TRUE").alias("enabled"))


def filing_index(rows: DataFrame, forms: list[str]) -> DataFrame:
    """Index lines ``cik|name|form|date|path``: chosen forms, accession from the path."""
    parts = F.split("line", r"\|")
    return rows.where(F.size(parts) == 5).select(
        F.lpad(parts[0], 10, "0").alias("cik"), parts[2].alias("form"), parts[3].alias("filed"),
        F.regexp_extract(parts[4], r"([0-9-]+)\.txt$", 1).alias("accession")).where(F.col("form").isin(*forms))


def normalised_text(text: Column) -> Column:
    """Whitespace runs collapsed, for word-for-word quote checks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_hits(quotes: DataFrame, documents: DataFrame, minimum: int = 10) -> DataFrame:
    """Whether each cited quote stands word for word in the document it cites (an equality join on the document).

    ``quotes``: quote_id, doc_id, quote. ``documents``: doc_id, text.
    """
    joined = quotes.join(documents.select("doc_id", "text"), "doc_id", "left")
    wanted = normalised_text(F.col("quote"))
    found = (F.length(wanted) >= minimum) & F.contains(normalised_text(F.col("text")), wanted)
    return joined.select("quote_id", "doc_id", F.coalesce(found, F.lit(False)).alias("found"))


def risk_level(text: Column, section: Column, interpretation: Column, citations: Column) -> tuple[Column, Column]:
    """(level, reasons) of a claim."""
    lowered = F.lower(text)
    terms = F.filter(F.array(*[F.lit(term) for term in MATERIAL_TERMS]), lambda term: F.contains(lowered, term))
    material = F.size(terms) > 0
    reasons = F.array_compact(F.array(
        F.when(interpretation, F.lit("interpretation")), F.when(section == "risks", F.lit("risk_section")),
        F.when(text.rlike(r"\d|%|\$"), F.lit("numeric_claim")),
        F.when(material, F.concat(F.lit("material_terms:"), F.array_join(terms, ","))),
        F.when(citations > 1, F.lit("multiple_citations"))))
    high = interpretation & ((section == "risks") | material)
    return F.when(high, "high").when(F.size(reasons) > 0, "medium").otherwise("low"), reasons


def sample_value(seed: str, claim_id: Column) -> Column:
    """Reproducible number in 0..100 from the first eight hex digits of a hash."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), claim_id), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(0xFFFFFFFF) * 100.0


#: Kinds of sources from the most to the least reliable, and the age beyond which one is stale.
SOURCE_TYPES = ("regulatory_filing", "company_ir", "earnings_release", "reputable_news")
MAXIMUM_AGE = 730


def document_errors(documents: DataFrame, domains: list[str], today: str) -> DataFrame:
    """Adds ``errors``, the texts of every rule that a document breaks, in the order of the rules.

    ``documents``: url, title, publisher, source_type, content_hash, published_at and retrieved_at as text. A null breaks the
    rule of its column.
    """
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    secure = F.coalesce(F.col("url").startswith("https://") & (F.coalesce(host, F.lit("")) != ""), F.lit(False))
    text = lambda name: F.trim(F.coalesce(name, F.lit("")))
    day = F.to_date(F.try_to_timestamp(F.substring("published_at", 1, 10), F.lit("yyyy-MM-dd")))
    rules = {
        "Evidence URLs must use HTTPS.": ~secure,
        "Evidence domain is not allowed": secure & ~allowed_url(F.col("url"), domains),
        "title is required": text("title") == "", "publisher is required": text("publisher") == "",
        "source_type is unsupported": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
        "content_hash must be SHA-256": F.coalesce(F.length("content_hash"), F.lit(0)) != 64,
        "published_at is required": text("published_at") == "",
        "published_at must be YYYY-MM-DD": (text("published_at") != "") & day.isNull(),
        "source is stale": F.coalesce(F.datediff(F.lit(today).cast("date"), day) > MAXIMUM_AGE, F.lit(False)),
        "retrieved_at must be ISO-8601": F.col("retrieved_at").try_cast("timestamp").isNull(),
    }
    return documents.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules.items()])))
