"""XBRL instance documents to long facts, as column expressions: element, context, unit and value of every fact.

Element names are open, so no fixed schema fits. An instance is flat (every fact is a child of the root and holds no
element), so facts, contexts, units and namespaces are cut out by pattern; a fact then looks its context, unit and
namespace up inside its own document, without a join across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import finite

NAME = r"[A-Za-z_][\w.\-]*"
#: What a namespace of each taxonomy looks like.
TAXONOMIES = (("us-gaap", r"fasb\.org/us-gaap/"), ("ifrs-full", r"xbrl\.ifrs\.org/taxonomy/.*ifrs-full/?$"), ("dei", r"xbrl\.sec\.gov/dei/"))


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute of the element's opening tag, '' without it."""
    return F.regexp_extract(element, rf"""^<[^>]*?\s(?:{NAME}:)?{name}\s*=\s*["']([^"']*)["']""", 1)


def inner(element: Column, name: str) -> Column:
    """Trimmed text of the first such element inside, '' without one."""
    return F.trim(F.regexp_extract(element, rf"(?s)<(?:{NAME}:)?{name}(?:\s[^>]*)?>([^<]*)<", 1))


def blocks(document: Column, name: str) -> Column:
    return F.regexp_extract_all(document, F.lit(rf"(?s)(<(?:{NAME}:)?{name}\s[^>]*>.*?</(?:{NAME}:)?{name}\s*>)"), F.lit(1))


def entry_of(key: Column, value: Column) -> Column:
    return F.named_struct(F.lit("key"), key, F.lit("value"), value)


def lookup(entries: Column) -> Column:
    """A map of entries(key, value); of equal keys the last one counts."""
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda held, entry: F.map_concat(
        F.map_filter(held, lambda key, _: key != entry.key), F.create_map(entry.key, entry.value)))


def instance_facts(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Facts of documents(accession, form, filed, document) whose tag the catalogue names, each once.

    ``catalogue``: tag ('us-gaap:Revenues'), concept, kind ('duration' or 'instant'), money (any currency) or unit; a
    settings-sized table. Namespaces count, not prefixes. Facts in contexts with a segment or scenario, with a unit of
    several measures, nil facts and values that are no numbers are left out, so a segment's figure never stands in for
    the company's. Durations have a start, instants have none. Null documents and texts without facts give no rows.
    """
    text = F.regexp_replace("document", r"(?s)<!--.*?-->", "")
    spaces = F.transform(F.regexp_extract_all(text, F.lit(rf"""(xmlns:{NAME}\s*=\s*["'][^"']*["'])"""), F.lit(1)), lambda entry: entry_of(
        F.regexp_extract(entry, rf"^xmlns:({NAME})", 1), F.regexp_extract(entry, r"""["']([^"']*)["']$""", 1)))
    whole = lambda element: ~element.rlike(rf"<(?:{NAME}:)?(?:segment|scenario)[\s/>]")
    contexts = F.transform(F.filter(blocks(text, "context"), whole), lambda element: entry_of(
        attribute(element, "id"),
        F.when(inner(element, "instant") != "", F.concat(F.lit("|"), F.substring(inner(element, "instant"), 1, 10)))
        .when((inner(element, "startDate") != "") & (inner(element, "endDate") != ""),
              F.concat_ws("|", F.substring(inner(element, "startDate"), 1, 10), F.substring(inner(element, "endDate"), 1, 10)))))
    measure = rf"(?s)<(?:{NAME}:)?measure(?:\s[^>]*)?>([^<]*)<"
    single = lambda element: F.size(F.regexp_extract_all(element, F.lit(measure), F.lit(1))) == 1
    units = F.transform(F.filter(blocks(text, "unit"), single), lambda element: entry_of(
        attribute(element, "id"), F.regexp_extract(inner(element, "measure"), r"([^:]*)$", 1)))
    elements = F.regexp_extract_all(text, F.lit(rf"(?s)(<{NAME}:{NAME}\s[^>]*contextRef\s*=[^>]*[^>/]>[^<]*)</"), F.lit(1))
    parsed = documents.select("accession", "form", "filed", lookup(spaces).alias("spaces"), lookup(contexts).alias("contexts"),
                              lookup(units).alias("units"), F.explode(elements).alias("element"))
    named = parsed.select(
        "accession", "form", "filed", F.try_element_at("spaces", F.regexp_extract("element", rf"^<({NAME}):", 1)).alias("space"),
        F.regexp_extract("element", rf"^<{NAME}:({NAME})", 1).alias("local"),
        F.try_element_at("contexts", attribute(F.col("element"), "contextRef")).alias("period"),
        F.try_element_at("units", attribute(F.col("element"), "unitRef")).alias("unit"), attribute(F.col("element"), "nil").alias("nil"),
        finite(F.trim(F.regexp_extract("element", r">([^<]*)$", 1))).alias("val"))
    taxonomy = F.coalesce(*[F.when(F.col("space").rlike(pattern), prefix) for prefix, pattern in TAXONOMIES])
    facts = named.where("period is not null and unit is not null and val is not null and nil <> 'true'").select(
        "accession", "form", "filed", F.concat_ws(":", taxonomy, "local").alias("tag"), F.nullif(F.split("period", r"\|")[0], F.lit("")).alias("start"),
        F.split("period", r"\|")[1].alias("end"), "unit", "val")
    known = facts.join(F.broadcast(catalogue.select("tag", "concept", "kind", "money", F.col("unit").alias("wanted"))), "tag")
    fits = ((F.col("kind") == "duration") == F.col("start").isNotNull()) & F.when(F.col("money"), F.col("unit").rlike("^[A-Z]{3}$")).otherwise(
        F.col("unit") == F.col("wanted"))
    return known.where(fits).select("accession", "concept", "tag", "start", "end", "val", "unit", "form", "filed").distinct()
