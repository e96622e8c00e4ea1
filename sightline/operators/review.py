"""Checks of written reviews against their evidence: declared constraints compiled to one array of error texts per review.

Constraints on single values are column expressions. Those that need other tables (the cited document and its hash, the
packet's figure, the metrics of the peer table) are looked up by key: every citation and figure is one row of a join, and the
errors come back per review.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.documents import normalised_text

#: Fixed values of the review schema.
VERDICTS = ("clear", "caution", "avoid", "not_reviewed")
AREAS = ("earnings_quality", "balance_sheet", "dilution", "going_concern", "pending_event", "business", "governance")
SEVERITIES = ("info", "concern", "serious")
DISCOUNT_ANSWERS = ("yes", "partly", "no", "not_cheaper", "insufficient_peers")
MINIMUM_QUOTE = 10
FORBIDDEN = (r"(?i)price target|target price|fair value of \$|expected return|upside of|downside of|position siz|% upside|% downside")
TOLERANCE = 1e-6

#: What ``check_reviews`` reads of a review.
CITATION = "sha256:string,quote:string"
SCHEMA = f"""ticker string, verdict string, deciding_reason string, bear_case string, unanswered_questions array<string>, evidence_through string,
  written_by string, data_check array<struct<field:string,ours:string,agrees:boolean,cited:boolean,{CITATION}>>,
  findings array<struct<area:string,severity:string,text:string,{CITATION}>>,
  peer_comparison struct<discount_explained:string,text:string,metrics_cited:array<string>>"""


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def outside(value: Column, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def each(items: Column, where: str, rules: Mapping[str, object]) -> Column:
    """Errors of every item of an array: ``<where>[i]: <rule>`` for each rule that holds for it."""
    filled = F.coalesce(items, F.array())
    return F.flatten(F.transform(filled, lambda item, i: F.array_compact(F.array(*[
        F.when(rule(item), F.concat(F.lit(f"{where}["), i.cast("string"), F.lit(f"]: {text}"))) for text, rule in rules.items()]))))


def own_errors(anchor: Column) -> Column:
    """Errors that the review shows by itself, in the order of the rules."""
    verdict, peers = F.col("verdict"), F.col("peer_comparison")
    day = F.to_date(F.try_to_timestamp("evidence_through", F.lit("yyyy-MM-dd")))
    serious = F.exists(F.coalesce("findings", F.array()), lambda f: F.coalesce(f.severity == "serious", F.lit(False)))
    wrong = F.exists(F.coalesce("data_check", F.array()), lambda d: ~F.coalesce(d.agrees, F.lit(True)))
    said = lambda name: F.coalesce(F.col(name).rlike(FORBIDDEN), F.lit(False))
    rules = {
        "verdict is not in the schema": outside(verdict, VERDICTS),
        "deciding_reason is empty": blank(F.col("deciding_reason")),
        "bear_case is empty": verdict.isin(*VERDICTS[:3]) & blank(F.col("bear_case")),
        "unanswered_questions must be a list": F.col("unanswered_questions").isNull(),
        "evidence_through is not a date": day.isNull(), "evidence_through is after the anchor date": day > anchor,
        "data_check must be a list": F.col("data_check").isNull(), "findings must be a list": F.col("findings").isNull(),
        "peer_comparison is missing": peers.isNull(),
        "discount_explained is not in the schema": peers.isNotNull() & outside(peers.discount_explained, DISCOUNT_ANSWERS),
        "peer_comparison must cite the metrics it used": peers.discount_explained.isin(*DISCOUNT_ANSWERS[:4]) & (
            F.size(F.coalesce(peers.metrics_cited, F.array())) == 0),
        "deciding_reason contains forbidden content": said("deciding_reason"), "bear_case contains forbidden content": said("bear_case"),
        "verdict avoid needs a serious finding or a disagreement": (verdict == "avoid") & ~serious & ~wrong,
        "only preparation may mark a name not_reviewed": (verdict == "not_reviewed") & ~F.coalesce(F.col("written_by") == "prepare", F.lit(False)),
    }
    plain = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(text)) for text, rule in rules.items()]))
    figures = each(F.col("data_check"), "data_check", {"agrees must be true or false": lambda d: d.agrees.isNull()})
    findings = each(F.col("findings"), "findings", {
        "area is not in the schema": lambda f: outside(f.area, AREAS), "severity is not in the schema": lambda f: outside(f.severity, SEVERITIES),
        "text is empty": lambda f: blank(f.text), "text contains forbidden content": lambda f: F.coalesce(f.text.rlike(FORBIDDEN), F.lit(False))})
    return F.concat(plain, figures, findings)


def citation_errors(reviews: DataFrame, documents: DataFrame) -> DataFrame:
    """ticker, error of every citation whose hash is none of the name's intact documents, or whose quote is not in it."""
    cited = F.concat(
        F.transform(F.filter(F.coalesce("data_check", F.array()), lambda d: F.coalesce(d.cited, F.lit(False))),
                    lambda d: F.named_struct(F.lit("place"), F.lit("data_check"), F.lit("sha256"), d.sha256, F.lit("quote"), d.quote)),
        F.transform(F.coalesce("findings", F.array()), lambda f: F.named_struct(
            F.lit("place"), F.lit("findings"), F.lit("sha256"), f.sha256, F.lit("quote"), f.quote)))
    rows = reviews.select("ticker", F.explode(cited).alias("c")).select("ticker", "c.*")
    intact = documents.where(F.sha2("text", 256) == F.col("sha256")).groupBy("ticker", "sha256").agg(F.first("text").alias("text"))
    joined = rows.join(intact, ["ticker", "sha256"], "left")
    quote = normalised_text(F.coalesce("quote", F.lit("")))
    error = F.when(F.col("text").isNull(), "cites a hash that is not one of this name's documents").when(
        F.length(quote) < MINIMUM_QUOTE, "quote is too short").when(~F.contains(normalised_text(F.col("text")), quote), "quote is not in the document")
    return joined.select("ticker", F.concat_ws(": ", "place", error).alias("error"), error.isNotNull().alias("bad")).where("bad").drop("bad")


def figure_errors(reviews: DataFrame, packet: DataFrame) -> DataFrame:
    """ticker, error of every compared figure that the packet(ticker, field, value) lacks or holds differently.

    Numbers may differ by 1e-6, absolute or of the packet's figure; other texts have to be equal; null equals null.
    """
    rows = reviews.select("ticker", F.explode("data_check").alias("d")).select("ticker", "d.field", "d.ours")
    joined = rows.join(packet.select("ticker", "field", F.col("value").alias("held"), F.lit(True).alias("known")), ["ticker", "field"], "left")
    ours, held = F.col("ours").try_cast("double"), F.col("held").try_cast("double")
    close = F.abs(ours - held) <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.abs(held))
    same = F.when(held.isNotNull(), F.coalesce(close, F.lit(False))).otherwise(F.col("ours").eqNullSafe(F.col("held")))
    error = F.when(F.col("known").isNull(), "is not a figure of the packet").when(~same, "is not the packet's figure")
    return joined.select("ticker", F.concat(F.lit("data_check: "), F.coalesce("field", F.lit("?")), F.lit(" "), error).alias("error")).where("error is not null")


def peer_errors(reviews: DataFrame, peers: DataFrame) -> DataFrame:
    """ticker, error of cited metrics that peers(ticker, status, metrics) lacks, and of answers without enough peers."""
    joined = reviews.select("ticker", "peer_comparison").where("peer_comparison is not null").join(peers, "ticker", "left")
    cited = F.coalesce("peer_comparison.metrics_cited", F.array())
    metrics = F.coalesce("metrics", F.array().cast("array<string>"))
    unknown = F.transform(F.filter(cited, lambda name: ~F.coalesce(F.array_contains(metrics, name), F.lit(False))), lambda name: F.concat(
        F.lit("peer_comparison: "), F.coalesce(name, F.lit("?")), F.lit(" is not a metric of the peer table")))
    few = ~F.coalesce(F.col("status") == "ok", F.lit(False)) & outside(F.col("peer_comparison.discount_explained"), DISCOUNT_ANSWERS[4:])
    answer = F.array_compact(F.array(F.when(few, "peer_comparison: the peer table has too few peers")))
    return joined.select("ticker", F.explode(F.concat(answer, unknown)).alias("error"))


def check_reviews(reviews: DataFrame, documents: DataFrame, packet: DataFrame, peers: DataFrame, anchor: str) -> DataFrame:
    """Every review with ``errors`` (its own, then those of its evidence, sorted) and ``review_status``.

    ``reviews``: the columns of ``SCHEMA``, one row a ticker. Status: valid, not_reviewed or validation_failed. A review that
    cites a document whose text no longer has its hash fails like one that cites none.
    """
    linked = citation_errors(reviews, documents).union(figure_errors(reviews, packet)).union(peer_errors(reviews, peers))
    found = linked.groupBy("ticker").agg(F.array_sort(F.collect_list("error")).alias("__linked"))
    checked = reviews.join(found, "ticker", "left")
    errors = F.concat(own_errors(F.lit(anchor).cast("date")), F.coalesce("__linked", F.array().cast("array<string>")))
    status = F.when(F.size("errors") > 0, "validation_failed").when(F.col("verdict") == "not_reviewed", "not_reviewed").otherwise("valid")
    return checked.withColumn("errors", errors).drop("__linked").withColumn("review_status", status)


def review_counts(checked: DataFrame) -> DataFrame:
    """Reviews per status and, for those that hold, per verdict; disagreements with filings are summed."""
    verdict = F.when(F.col("review_status") != "validation_failed", F.col("verdict"))
    wrong = F.size(F.filter(F.coalesce("data_check", F.array()), lambda d: ~F.coalesce(d.agrees, F.lit(True))))
    return checked.groupBy("review_status", verdict.alias("verdict")).agg(F.count("*").alias("reviews"), F.sum(wrong).alias("disagreements"))


def stable_id(columns: Mapping[str, Column], digits: int = 6, length: int = 16) -> Column:
    """An id of named values: SHA-256 over canonical JSON with sorted keys and fixed numbers, the same for any column order.

    Numbers are written with ``digits`` decimals, dates in ISO form, null as null; texts are escaped as in JSON.
    """
    parts = []
    for name in sorted(columns):
        value = columns[name]
        text = F.when(value.isNull(), F.lit("null")).otherwise(F.to_json(F.struct(value.cast("string").alias("v"))))
        number = F.format_string(f"%.{digits}f", value.cast("string").try_cast("double"))
        numeric = F.typeof(value).isin("double", "float", "int", "bigint", "smallint", "tinyint") | F.startswith(F.typeof(value), F.lit("decimal"))
        body = F.when(numeric & value.isNotNull(), number).otherwise(F.regexp_replace(text, r'^\{"v":(.*)\}$', "$1"))
        parts.append(F.concat(F.lit(f'"{name}":'), body))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, length)
