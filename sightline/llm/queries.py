"""Queries of the operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (chat, jpeg, language, lines, mixing, near, pieces, quality, resharding, suffix_tree, urls,
                           variants, whitening)
from sightline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Target shares of tokens. Values that are not named share ``*``.
SOURCE_TARGETS = {"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.06, "*": 0.66}
LANG_TARGETS = {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.19, "*": 0.01}
TOPIC_TARGETS = {"prose": 0.90, "list": 0.05, "shouted": 0.02, "numeric": 0.03}
MIX_FRACTION = 0.5

OLD_SHARDS, NEW_SHARDS = 6, 8

RULES = (urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"),
         urls.Rule("allow", "org", "/fr/"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def mixed(documents: DataFrame) -> DataFrame:
    with_topic = documents.withColumn("mix_topic", mixing.topic(F.col("text")))
    return mixing.mix(with_topic, {"source": SOURCE_TARGETS, "lang": LANG_TARGETS, "mix_topic": TOPIC_TARGETS}, MIX_FRACTION)


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"))


@query
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = jpeg.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = jpeg.read_media(media)
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "info.payload_bytes", "info.payload_sha256", "info.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "info.width", "info.height"), "info.thumb_hash", "info.thumb_sha256")
        .alias("feature"), "info.images", "info.width", "info.height")


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    identifier = language.train(documents.where(~held_out))
    found = language.identify(documents.select("doc_id", "text"), identifier)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score",
                        "language.rejected", F.round("language.bits", 6).alias("bits"))


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return found.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), RULES)


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(more)))


ORACLE_SQL["op6_urls"] = r"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (page_id)
"""

ORACLE_SQL["op7_chat"] = r"""
WITH rows_all AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') AS shown,
         replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') AS named
  FROM rows_all)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(named) + length(shown) + 20) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""


@query
def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_info.n_lines", "line_info.n_dropped", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.withColumn("held_out", language.remainder(F.col("doc_id"), 7) == 2)
    tree, counts = suffix_tree.vocabulary(documents.where("not held_out"))
    placed = suffix_tree.place_words(documents, tree)
    suffix_tree.grow(tree, placed.where("not held_out"), counts)
    return suffix_tree.score_placed(placed, tree, counts)


ORACLE_SQL["op3_near"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""


def _quality_sql() -> str:
    limits = quality.Limits()
    names = list(quality.COMMON_WORDS)
    size = "length(regexp_replace(t, '[^{0}]', '', 'g'))"
    classes = [size.format(part) for part in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", "#*$%&|<>")]
    words = {name: [f"len(list_filter(lw, lambda x: x = '{word}'))" for word in listed] for name, listed in quality.COMMON_WORDS.items()}
    entropy = "-list_sum(list_transform({0}, lambda p: CASE WHEN p > 0 THEN p * log2(p) ELSE 0.0 END))"
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS MATERIALIZED (
  SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - {classes[3]} AS BIGINT) AS word_chars, CAST({classes[4]} AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [{", ".join(classes)}, length(t) - ({" + ".join(classes)})] AS cc, list_transform(w, lambda x: lower(x)) AS lw
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS MATERIALIZED (
  SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM m),
c AS MATERIALIZED ({" UNION ALL ".join(f"SELECT doc_id, lang, n_words, base_failed, '{name}' AS name, cc, [{', '.join(words[name])}] AS cw FROM b" for name in names)}),
h AS MATERIALIZED (SELECT doc_id, lang, n_words, base_failed, name, cc, list_append(cw, n_words - list_sum(cw)) AS cw FROM c),
rs AS (
  SELECT name, [{", ".join(f"sum(cc[{i}])" for i in range(1, 7))}] AS qc, [{", ".join(f"sum(cw[{i}])" for i in range(1, 14))}] AS qw FROM h
  WHERE lang = name AND NOT base_failed AND n_words >= {limits.guard_words} GROUP BY 1),
rf AS (SELECT name, list_transform(qc, lambda x: x::DOUBLE / list_sum(qc)) AS qc, list_transform(qw, lambda x: x::DOUBLE / list_sum(qw)) AS qw FROM rs),
sh AS (
  SELECT doc_id, qc, qw, list_transform(cc, lambda x: x::DOUBLE / list_sum(cc)) AS pc, list_transform(cw, lambda x: x::DOUBLE / list_sum(cw)) AS pw,
    list_sum(cc) AS tc, list_sum(cw) AS tw FROM h JOIN rf USING (name)),
md AS (
  SELECT *, list_transform(range(1, 7), lambda i: (pc[i] + qc[i]) / 2) AS mc, list_transform(range(1, 14), lambda i: (pw[i] + qw[i]) / 2) AS mw FROM sh),
ds AS (
  SELECT doc_id,
    min(CASE WHEN tc > 0 THEN sqrt(greatest({entropy.format("mc")} - ({entropy.format("pc")} + {entropy.format("qc")}) / 2, 0.0)) ELSE 0.0 END) AS dc,
    min(CASE WHEN tw > 0 THEN sqrt(greatest({entropy.format("mw")} - ({entropy.format("pw")} + {entropy.format("qw")}) / 2, 0.0)) ELSE 0.0 END) AS dw
  FROM md GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {limits.guard_words} AND (dc > {limits.max_class_distance} OR dw > {limits.max_word_distance})) AS kept,
  round(dc, 6) AS class_distance, round(dw, 6) AS word_distance
FROM b JOIN ds USING (doc_id)
"""


ORACLE_SQL["op10_quality"] = _quality_sql()


@query
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus lies in 6 shards by source, which are far from equal; it is moved to 8 of equal bytes."""
    documents = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    found = resharding.reshard(documents, old, NEW_SHARDS)
    return found.select("doc_id", "placed.size", resharding.checksum(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"),
                        "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"),
                        F.col("placed.old").alias("old_shard"), "placed.moved")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    each = found.select("vec_id", "white", F.posexplode("white.values").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "white.n", "white.deviation", "whitened",
                       F.get("white.explained", F.col("at")).alias("explained"), "white.identity_error")


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    runs = documents.select("doc_id", F.explode(variants.letter_runs(F.col("text"))).alias("run"))
    found = variants.variant_groups(variants.count_words(variants.with_slips(runs, "doc_id")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: SQL of a relation crc(t) with the table of the checksum's bytes, and of the checksum of a string given that table.
CRC_TABLE = """(SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY k) AS t FROM range(256) AS r(k))"""


def _crc(text: str) -> str:
    held = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295, list_reduce({held}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295))"


ORACLE_SQL["op11_shards"] = rf"""
WITH c AS MATERIALIZED {CRC_TABLE},
d AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32,
    CAST({_crc("coalesce(source, '')")} % {OLD_SHARDS} AS INT) AS old FROM documents, c),
b AS MATERIALIZED (
  SELECT d.*, {_crc("concat_ws(':', doc_id::VARCHAR, text_crc32::VARCHAR)")} % {resharding.BLOCKS} AS block FROM d, c),
s AS (SELECT old, block, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT CAST(sum(bytes) AS BIGINT) AS total FROM s),
cap AS (SELECT k AS shard, total // {NEW_SHARDS} + CASE WHEN k < total % {NEW_SHARDS} THEN 1 ELSE 0 END AS cap FROM t, range({NEW_SHARDS}) AS r(k)),
o AS (SELECT old, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY 1),
same AS (SELECT old, shard, bytes, cap, least(coalesce(bytes, 0), coalesce(cap, 0)) AS stay FROM o FULL JOIN cap ON old = shard),
give AS (SELECT old, sum(bytes - stay) OVER (ORDER BY old) - (bytes - stay) AS lo, sum(bytes - stay) OVER (ORDER BY old) AS hi FROM same WHERE old IS NOT NULL),
take AS (SELECT shard, sum(cap - stay) OVER (ORDER BY shard) - (cap - stay) AS lo, sum(cap - stay) OVER (ORDER BY shard) AS hi FROM same WHERE shard IS NOT NULL),
flow AS (
  SELECT old, shard, stay AS amount FROM same WHERE stay > 0
  UNION ALL SELECT old, shard, least(give.hi, take.hi) - greatest(give.lo, take.lo) FROM give JOIN take ON give.lo < take.hi AND take.lo < give.hi),
span AS (SELECT old, shard, 2 * (sum(amount) OVER w - amount) AS low, 2 * sum(amount) OVER w AS high
  FROM flow WHERE amount > 0 WINDOW w AS (PARTITION BY old ORDER BY old <> shard, shard)),
line AS (SELECT *, 2 * sum(bytes) OVER (PARTITION BY old ORDER BY bytes DESC, block) - bytes AS middle FROM s),
p AS (SELECT line.old, block, shard FROM line JOIN span ON line.old = span.old AND middle >= low AND middle < high)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(NULL AS INT) AS grown_shard, old AS old_shard, old <> shard AS moved,
  row_number() OVER (PARTITION BY shard ORDER BY old, block, doc_id NULLS FIRST, text_crc32) - 1 AS slot
FROM b JOIN p USING (old, block)
"""

ORACLE_SQL["op13_variants"] = rf"""
WITH RECURSIVE c AS MATERIALIZED {CRC_TABLE},
r AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM r, c),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, x.word, x.n FROM w JOIN x ON w.word = x.less
  UNION SELECT x.word, x.n, w.word, w.n FROM w JOIN x ON w.word = x.less),
k AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN k ON k.word = w.word AND place = 1),
up(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
top AS (SELECT up.word, root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN top ON top.word = f.word
"""
