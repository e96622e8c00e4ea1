"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised and joined on runs of ``RUN`` words. k edited words change at most ``RUN * k`` of a line's runs, so
of two lines within k edits the first ``RUN * k + 1`` runs of each, in an order common to all lines, share one: no
similar pair is missed. Pairs that meet are verified by edit similarity; of each group of connected lines one occurrence
stays, all other occurrences go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import connected_components, forget, stored

#: Words of a run; a line of 9 words (one edit away from one of 10) has enough runs for it.
RUN = 4
#: Runs that are frequent in a sample of the documents (one of SAMPLE) come last in the order, so that lines meet at rare
#: ones; this changes the work, not the result.
SAMPLE, FREQUENT, LISTED = 32, 4, 4000
#: Only for brute force in tests: of that many SimHash bits, lines of 90 % equal words differ in at most DISTANCE but for a
#: chance of about 1e-6 (one word of 10: 7 on average), so other pairs need no edit distance. Nothing here screens by it.
BITS, DISTANCE = 60, 20
SIMILARITY = 90  # percent of the longer line's words that an edit script leaves alone
MIN_WORDS = 5  # shorter lines ("Yes.", "} else {") repeat for good reasons and always stay
#: All ASCII but letters and line breaks counts as a gap between words.
GAPS = r"[\x00-\x09\x0B-\x40\x5B-\x60\x7B-\x7F]+"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def runs(words: Column) -> Column:
    """Hashes of the runs of ``RUN`` words of a line, below 2^62; none for fewer words."""
    starts = F.sequence(_long(0), F.size(words) - RUN)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, (i + k).cast("int")) for k in range(RUN)]))
    return F.when(F.size(words) >= RUN, F.transform(hashed, lambda h: F.shiftrightunsigned(h, 2)))


def keys(runs_: Column, n: Column, frequent: list[int]) -> Column:
    """The runs at which a line of n words meets others. A partner has at most n / 0.9 words, so at most n / 9 are edited."""
    last = F.transform(runs_, lambda h: F.when(h.isin(frequent), h.bitwiseOR(_long(1 << 62))).otherwise(h)) if frequent else runs_
    edits = F.floor(n * (100 - SIMILARITY) / F.lit(float(SIMILARITY))).cast("int")
    first = F.slice(F.sort_array(last), F.lit(1), edits * RUN + 1)
    return F.when(edits > 0, F.array_distinct(first)).otherwise(F.array().cast("array<bigint>"))


def frequent_runs(split: DataFrame) -> list[int]:
    """The most frequent runs of a sample of the documents, at most ``LISTED``."""
    some = split.where(F.col("mark").bitwiseAND(_long(SAMPLE - 1)) == 0).dropDuplicates(["line"])
    counted = some.select(F.explode(F.array_distinct(runs(F.col("hashes")))).alias("run")).groupBy("run").count()
    listed = counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "run").limit(LISTED)
    return [row["run"] for row in listed.collect()]


def coded(words: Column) -> Column:
    """Words as single characters (a hash into the characters U+1000 to U+9FFF): edits of words become edits of text."""
    digits = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0x9000)) + 0x1000), 4, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-16BE")


#: Longs of a line's word mask.
MASKS = 4


def masks(words: Column) -> list[Column]:
    """``MASKS`` longs with the bit of every word set; words that ``coded`` takes for equal have the same bit."""
    bits = F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(0x9000)) % (64 * MASKS)).cast("int"))
    part = lambda k: F.filter(bits, lambda bit: F.floor(bit / 64) == k)
    one = F.lit(1).cast("long")
    return [F.aggregate(part(k), F.lit(0).cast("long"), lambda mask, bit: mask.bitwiseOR(F.call_function("shiftleft", one, bit % 64)))
            for k in range(MASKS)]


def maybe_similar(l, r) -> Column:
    """True for all similar lines and few others: an edit of a word changes two bits of the masks at most."""
    limit = F.floor(F.greatest(l("n_words"), r("n_words")) * (100 - SIMILARITY) / 100.0)
    apart = sum((F.bit_count(l(f"m{k}").bitwiseXOR(r(f"m{k}"))) for k in range(1, MASKS)), F.bit_count(l("m0").bitwiseXOR(r("m0"))))
    return (F.abs(l("n_words") - r("n_words")) <= limit) & (apart <= 2 * limit)


def similar(a: Column, b: Column) -> Column:
    """At most 10 % of the words of the longer line are edited; the distance is only computed up to that limit."""
    limit = F.floor(F.greatest(F.length(a), F.length(b)) * (100 - SIMILARITY) / 100.0).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= limit) & (F.call_function("levenshtein", a, b, limit) >= 0)


def normalised(text: Column) -> Column:
    """Lower case, ASCII letters and all other scripts kept, everything else a space; line breaks stay."""
    return F.regexp_replace(F.lower(text), GAPS, " ")


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), " ")


def occurrences(documents: DataFrame, text: str, key: str) -> DataFrame:
    """id, mark (hash of the text), pos, line (hash of the words) and keys of lines with enough words."""
    base = documents.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("mark"),
                            F.posexplode(F.split(normalised(F.col(text)), "\n")).alias("pos", "raw"))
    enough = base.where(F.col("raw").rlike(f"^ *(?:[^ ]++ ++){{{MIN_WORDS - 1}}}+[^ ]"))
    split = enough.select("id", "mark", "pos", words_of(F.col("raw")).alias("words"))
    split = split.select("id", "mark", "pos", F.xxhash64("words").alias("line"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    found = split.withColumn("runs", runs(F.col("hashes")))
    return found.select("id", "mark", "pos", "line", keys(F.col("runs"), F.size("hashes"), frequent_runs(split)).alias("keys"))


def groups(documents: DataFrame, found: DataFrame, lines: DataFrame, text: str, key: str) -> DataFrame:
    """line, first, n and root of all lines that are linked with another one.

    Keys are read from the occurrences ``found``, so no shuffle carries lists of keys; a key counts if two lines hold it.
    ``found`` is a stored stage and is removed once its keys have been joined.

    Only lines that share a key get their words (from one occurrence each). At every key the lines are linked with its
    smallest first; only pairs without a common such hub are compared after that.
    """
    keyed = found.select("line", F.explode("keys").alias("block"))
    hubs = stored(keyed.groupBy("block").agg(F.min("line").alias("hub"), F.max("line").alias("last")).where("hub <> last").select("block", "hub"), free=True)
    paired = stored(keyed.join(hubs, "block").distinct(), free=True)
    forget(found)
    wanted = paired.select("line").distinct().join(lines, "line").groupBy(
        F.col("first.id").alias("fid"), F.col("first.mark").alias("fmark")).agg(
        F.collect_list(F.struct("line", "first", "n")).alias("asked"))
    source = documents.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    found = source.join(wanted, F.col("id").eqNullSafe(F.col("fid")) & (F.col("mark") == F.col("fmark")))
    cut = found.select(F.explode("asked").alias("x"), F.split("text", "\n").alias("raw"))
    words = words_of(normalised(F.get("raw", F.col("x.first.pos"))))
    fetched = cut.select("x.*", words.alias("words")).select(
        "line", "first", "n", coded(F.col("words")).alias("code"), *[mask.alias(f"m{k}") for k, mask in enumerate(masks(F.col("words")))])
    texts = stored(fetched.dropDuplicates(["line"]), free=True)

    star = paired.where("line <> hub").select("line", "hub").distinct().join(texts.select("line", "code"), "line")
    at_hub = texts.select(F.col("line").alias("hub"), F.col("code").alias("code2"))
    links = stored(star.join(at_hub, "hub").where(similar(F.col("code"), F.col("code2"))).select("line", "hub"), free=True)
    label = links.groupBy("line").agg(F.min("hub").alias("label"))

    # Pairs meet with their masks alone; texts are fetched for the few that pass.
    narrow = [F.col(f"m{k}") for k in range(MASKS)]
    rest = texts.join(label, "line", "left").select("line", F.length("code").alias("n_words"), F.coalesce("label", "line").alias("label"), *narrow)
    # A self join under two aliases: both sides keep their names, so they read one exchange.
    left = paired.select("line", "block").join(rest, "line")
    l, r = (lambda name: F.col(f"l.{name}")), (lambda name: F.col(f"r.{name}"))
    met = left.alias("l").join(left.alias("r"), (l("block") == r("block")) & (l("line") < r("line")) & (l("label") != r("label")) & maybe_similar(l, r))
    met = stored(met.select(l("line").alias("line"), r("line").alias("line2"), l("label").alias("label"), r("label").alias("label2")).distinct(), free=True)
    at_second = texts.select(F.col("line").alias("line2"), F.col("code").alias("code2"))
    across = met.join(texts.select("line", "code"), "line").join(at_second, "line2").where(similar(F.col("code"), F.col("code2")))
    # A line is linked with its label already, so two groups need one link between their labels, however many pairs meet.
    between = across.select(F.greatest("label", "label2"), F.least("label", "label2")).distinct()
    both = links.select(F.col("line").alias("a"), F.col("hub").alias("b")).union(between)
    roots = connected_components(both, free=True).select(F.col("node").alias("line"), "root")
    return texts.select("line", "first", "n").join(roots, "line")


def dedup_lines(documents: DataFrame, text: str = "text", key: str = "doc_id", info: str = "line_info") -> DataFrame:
    """Documents without repeated lines: ``text`` loses every line whose group has an earlier occurrence.

    Lines are what ``\\n`` separates. Lines of fewer than ``MIN_WORDS`` words, null and empty texts stay as they are.
    The earliest occurrence is the one with the smallest (key, hash of the text, position), null keys last; rows equal
    in key and text share one decision. Adds the struct ``info``: n_lines, n_dropped. All other columns stay; a column
    named like ``info`` is replaced. An empty table gives an empty table.

    Shuffles move hashes (about 40 bytes a line and 8 for every two words), and texts twice: once to fetch the lines that
    share a key, once to cut the lines. A line that holds a third of all lines is one row after a combined aggregation.
    """
    keyed = stored(occurrences(documents, text, key))
    found = stored(keyed.drop("keys"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "pos")
    lines = stored(found.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n")), free=True)
    linked = stored(groups(documents, keyed, lines, text, key), free=True)
    alone = lines.where("n > 1").join(linked, "line", "left_anti").select("line", "first", "n", F.col("line").alias("root"))
    grouped = linked.union(alone)
    first = grouped.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("total")).where("total > 1")
    again = grouped.select("line", "root").join(first, "root").select("line", "best")
    dropped = found.join(again, "line").where(~(
        F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")) & (F.col("pos") == F.col("best.pos"))))
    cuts = dropped.groupBy("id", "mark").agg(F.array_distinct(F.collect_list("pos")).alias("cut"))
    # The row travels in a struct, so its columns may have any name.
    marked = documents.select(F.struct(*[name for name in documents.columns if name != info]).alias("row"), F.xxhash64(F.col(text)).alias("at"))
    joined = marked.join(cuts, F.col(f"row.{key}").eqNullSafe(F.col("id")) & (F.col("at") == F.col("mark")), "left")
    whole = F.col(f"row.{text}")
    parts = F.split(whole, "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col("cut"), i)), "\n")
    counted = F.struct(F.when(whole.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"))
    done = joined.select("row", F.when(F.col("cut").isNull(), whole).otherwise(kept).alias("text_"), counted.alias("info_"))
    return done.select(*[F.col("text_").alias(text) if name == text else F.col(f"row.`{name}`") for name in documents.columns if name != info],
                       F.col("info_").alias(info))
