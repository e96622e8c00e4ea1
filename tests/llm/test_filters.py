"""URL rules, quality rules, language ID, mixing and suffix-tree scores against plain re-computations."""

import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.llm import language, mixing, quality, queries, suffix_tree, urls
from sightline.llm.common import stored

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- URL rules --------------------------------------------------------------------------------------------------------

def _judge(url, rules):
    _, found, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if found else ""
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0] if found else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.label), len(r.host)), default=None)
    return host, path, best.label if best else None, best.verdict if best else "allow"


def test_url_rules(spark):
    rules = [*queries.RULES, urls.Rule("block", "a.example.net", "/en/x"), urls.Rule("allow", "b.a.example.net", "/"),
             urls.Rule("block", "com", "/longer/path/"), urls.Rule("allow", "example.com", "/lo")]
    hosts = ["net", "NET", "a.example.net", "b.a.Example.net", "xexample.net", "example.com", "c.example.com", "org", "x.org:80", "", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/xy?/fr/", "/de/#q", "/fr/a", "/longer/path/z", "?q=/en/"]
    listed = [f"{scheme}{host}{path}" for scheme in ("http://", "https://u@", "") for host in hosts for path in paths]
    listed += [None, "", "://", "http://a.net/\n/x", "http://É.net/en/", "http://a.net/http://b.org/fr/"]
    frame = spark.createDataFrame(list(enumerate(listed)) * 2, "page_id long, url string").selectExpr("*", "'c' as host")
    for chosen in (rules, []):
        found = urls.url_verdicts(frame, chosen, partitions=5).collect()
        assert len(found) == 2 * len(listed)
        for row in found:
            assert (row["host"], row["path"], row["rule"], row["verdict"]) == _judge(listed[row["page_id"]], chosen), listed[row["page_id"]]
    assert urls.url_verdicts(frame.limit(0), rules).count() == 0


# --- quality ----------------------------------------------------------------------------------------------------------

def _base(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i: i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def _distance(counts, reference):
    if not sum(counts):
        return 0.0
    p, q = np.array(counts) / sum(counts), np.array(reference)
    entropy = lambda x: -(x[x > 0] * np.log2(x[x > 0])).sum()
    return math.sqrt(max(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0.0))


def test_quality_rules(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, None, "en"), (9002, "", None), (9003, "a b c a b c a b", "xx"), (9004, "\n\n x \n x \n", "en"), (9004, " a  b", "de"),
           (9005, "w " * 500, "en"), (9006, "a b c", "en")]
    whole = documents.union(spark.createDataFrame(odd, documents.schema)).selectExpr("*", "1 as n_words")
    whole = stored(whole.withColumn("seq", F.monotonically_increasing_id()))
    limits = quality.Limits()
    rows = whole.toPandas().sort_values("seq")
    texts = rows["text"].map(lambda t: t if isinstance(t, str) else None)
    held = stored(quality.measure(whole, keep=("seq", "lang")))
    measured = held.toPandas().sort_values("seq")
    base = [_base(text) for text in texts]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(row) for row in measured[names].to_numpy().tolist()] == base
    known = quality.references(held, limits)
    found = quality.quality_verdicts(whole, limits, keep=("seq",)).toPandas().sort_values("seq")
    for row, (n, *_, repeat), (_, histogram) in zip(found.itertuples(), base, measured.iterrows()):
        failed = n < 50 or 100 * repeat > 50 * n
        listed = sorted({w for part in quality.COMMON_WORDS.values() for w in part})
        far_class = min(_distance(histogram["class_counts"], c) for c, _ in known.values())
        far_word = []
        for name, (_, reference) in known.items():
            mine = [histogram["word_counts"][listed.index(w)] for w in quality.COMMON_WORDS[name]]
            far_word.append(_distance([*mine, n - sum(mine)], reference))
        assert row.class_distance == pytest.approx(far_class, abs=2e-6) and row.word_distance == pytest.approx(min(far_word), abs=2e-6)
        judged = n >= limits.guard_words and (far_class > limits.max_class_distance or min(far_word) > limits.max_word_distance)
        assert row.base_failed == failed and row.kept == (not failed and not judged)
    none = quality.quality_verdicts(whole.limit(0))
    assert none.count() == 0
    alone = quality.quality_verdicts(spark.createDataFrame([(1, "x " * 60, None)], documents.schema)).first()
    assert not alone["kept"] and alone["base_failed"]


def test_clean_documents_stay(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.quality_verdicts(documents).join(labels, "doc_id").where("quality = 1 and not base_failed").toPandas()
    assert found["kept"].all() and len(found) > 200


# --- language ---------------------------------------------------------------------------------------------------------

def test_kneser_ney_is_a_distribution():
    text = "abracadabra abba cabbage rabbit barb"
    batch = pd.DataFrame({"lang": ["x"], "text": [text]})
    table = pd.concat(language._count(iter([batch])))
    model = language.Model.train([table[table["gram_order"] == o] for o in range(1, language.ORDER + 1)])
    alphabet = sorted(set(f" {text} "))
    for context in ("  a", " ab", "bra", "abb", "cab"):
        total = 0.0
        for c in alphabet:
            codes = np.array([ord(x) for x in context + c], np.uint32)
            keys = [language.grams(codes, o)[-1:] for o in range(1, language.ORDER + 1)]
            prefixes = [np.zeros(1, np.int64)] + [language.grams(codes, o - 1)[-2:-1] for o in range(2, language.ORDER + 1)]
            total += 2.0 ** model.score(keys, prefixes)[0]
        assert 0.9 < total < 1.0001, context  # what is missing belongs to unseen characters


def test_windows_do_not_change_entropies(monkeypatch):
    table = pd.concat(language._count(iter([pd.DataFrame({"lang": ["x"], "text": ["the cat sat on the mat " * 20]})])))
    model = language.Model.train([table[table["gram_order"] == o] for o in range(1, language.ORDER + 1)])
    identifier = language.Identifier(["x"], [model], np.array([np.inf]))
    texts = ["the cat", "", "mat " * 50, "q"]
    whole = identifier.entropies(texts)
    monkeypatch.setattr(language, "WINDOW", 7)
    assert np.allclose(identifier.entropies(texts), whole)


def test_language_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op4_language"](spark, folder).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert not found["rejected"].mean() > 0.02
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]).all()


def test_language_edge_cases(spark):
    learned = [(i, text * 10, lang) for i, (text, lang) in enumerate([("the cat sat ", "en"), ("der hund und ", "de")] * 20)]
    frame = spark.createDataFrame(learned + [(90, None, "en"), (91, "nobody ", None)], "doc_id long, text string, lang string")
    identifier = language.train(frame)
    assert identifier.languages == ["de", "en"]
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the cat"), (5, "der hund"), (5, "der hund"), (6, "漢字漢字漢字")],
                                  "doc_id long, text string").selectExpr("*", "1 as language")
    out = [(r["doc_id"], r["language"]["lang_pred"], r["language"]["rejected"]) for r in language.identify(asked, identifier).orderBy("doc_id").collect()]
    assert out == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (5, "de", False), (5, "de", False), out[6]]
    assert out[6][2]
    empty = language.train(frame.limit(0))
    assert language.identify(asked, empty).first()["language"]["lang_pred"] == "und"


# --- mixing -----------------------------------------------------------------------------------------------------------

def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    mass = rng.random((4, 3, 2)) * 100
    targets = [np.array([.4, .3, .2, .1]), np.array([.5, .25, .25]), np.array([.9, .1])]
    fitted = mixing.rake(mass, targets)
    for axis, target in enumerate(targets):
        assert np.allclose(fitted.sum(tuple(a for a in range(3) if a != axis)), target, atol=1e-9)
    ratio = fitted / mass  # raking keeps interactions: the ratio is a product of factors per class
    assert np.allclose(ratio[0, 0, 0] * ratio[1, 1, 0], ratio[0, 1, 0] * ratio[1, 0, 0])
    weight, probability = mixing.probabilities(mass, fitted, 0.5)
    assert (probability <= 1).all() and (probability * mass).sum() == pytest.approx(0.5 * mass.sum())
    free = probability < 1
    assert np.ptp((probability / weight)[free]) < 1e-9


def test_mixing_edge_cases(spark):
    rows = [(i, f"w {'x ' * (i % 7)}", ["a", "b", "c", None][i % 4], "en" if i % 3 else None) for i in range(400)]
    rows += [(None, None, "a", "en"), (5, "", "b", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as mix_weight")
    marginals = {"source": {"a": 0.5, "b": 0.3, "*": 0.2}, "lang": {"en": 1.0}}
    out = mixing.mix(frame, marginals, 0.4).toPandas()
    assert len(out) == len(rows)
    assert not out.loc[out["lang"].isna(), "mix_kept"].any()
    expected = (out["mix_tokens"] * out["mix_probability"]).sum() / out["mix_tokens"].sum()
    assert expected == pytest.approx(0.4, abs=1e-6)
    # a small cell reaches probability 1, or all shares are met
    again = mixing.mix(frame, marginals, 0.4).toPandas()
    assert (again["mix_kept"] == out["mix_kept"]).all()
    assert mixing.mix(frame.limit(0), marginals, 0.4).count() == 0
    assert not mixing.mix(frame, {"source": {"zz": 1.0}}, 0.5).where("mix_probability > 1").count()


def test_mixing_query_meets_targets(spark):
    found = queries.QUERIES["op1_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    drawn = (found["n_tokens"] * found["probability"])
    assert drawn.sum() / found["n_tokens"].sum() == pytest.approx(queries.MIX_FRACTION, abs=1e-3)
    assert found[found["kept"]]["n_tokens"].sum() == pytest.approx(drawn.sum(), rel=0.15)
    weighted = (found["n_tokens"] * found["weight"]).groupby(found["lang"]).sum() / found["n_tokens"].sum()
    named = {lang: share for lang, share in queries.LANG_TARGETS.items() if lang in weighted}  # absent classes share theirs out
    for lang, share in named.items():
        assert weighted[lang] == pytest.approx(share / sum(named.values()), abs=0.01)


# --- suffix tree ------------------------------------------------------------------------------------------------------

def test_base_scores_and_normalisation(spark):
    rows = [(i, ["the cat sat on the mat", "the dog sat on a log the end", None, "", "A  B\ta"][i % 5] + f" w{i}" if i % 5 not in (2, 3) else
             [None, ""][i % 2]) for i in range(60)]
    frame = spark.createDataFrame([*rows, (None, "the cat"), (3, "the cat")], "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    train = frame.where("doc_id % 3 > 0")
    tree, counts = suffix_tree.train(train)
    seen = collections.Counter()
    for i, text in [*rows, (None, "the cat"), (3, "the cat")]:
        if i is not None and i % 3 > 0:
            seen.update([*(text or "").encode().lower().split(), None])
    n, v = sum(seen.values()), len(seen)
    assert (tree.tokens, tree.distinct) == (n, v)
    out = suffix_tree.score_texts(frame, tree, counts).toPandas()
    want = sorted((len(w), sum(x in seen for x in w), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 9))
                  for w in ([*(t or "").encode().lower().split(), None] for _, t in [*rows, (None, "the cat"), (3, "the cat")]))
    assert sorted((a, b, round(c, 9)) for a, b, c in zip(out["n_tokens"], out["n_known"], out["base_score"])) == want
    assert any(len(level.states) for level in tree.levels)
    assert out["score"].sum() > out["base_score"].sum()
    words = np.arange(tree.width)
    unseen = 1 - (tree.counts + 1).sum() / (n + v + 1)
    for depth, level in enumerate(tree.levels, 1):
        for state in level.states:
            before = [np.array([state % tree.width]), np.array([state // tree.width if depth > 1 else -1])]
            mass = (10 ** tree.score(words, [np.repeat(b, len(words)) for b in before])).sum()
            assert mass + 10 ** tree.score(np.array([-1]), before)[0] * unseen == pytest.approx(1)


def test_suffix_tree_without_documents(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tree, counts = suffix_tree.train(frame.limit(0))
    row = suffix_tree.score_texts(frame, tree, counts).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert suffix_tree.score_texts(frame.limit(0), tree, counts).count() == 0


def _whole_model(texts):
    """Values of all states by context, of any count: {context: (fallback, {word: log10 value})}, and the root."""
    ends = ("<s>", "</s>")
    listed = [[ends[0], *(t or "").lower().split(), ends[1]] for t in texts]
    runs = collections.Counter(tuple(w[i: i + n]) for w in listed for n in range(1, suffix_tree.DEPTH + 2) for i in range(len(w) - n + 1))
    words = {r[0]: n for r, n in runs.items() if len(r) == 1 and r[0] != ends[0]}
    tokens, kinds = sum(words.values()), len(words)
    root = lambda w: math.log10((words.get(w, 0) + 1) / (tokens + kinds + 1))
    below = collections.defaultdict(dict)
    for r, n in runs.items():
        if len(r) > 1 and n >= suffix_tree.WORD_COUNT:
            below[r[:-1]][r[-1]] = n
    states = {}
    for c in sorted(below, key=len):
        size = runs[c]
        if size < suffix_tree.CONTEXT_COUNT or len(c) > suffix_tree.DEPTH or (len(c) > 1 and c[1:] not in states):
            continue
        up = {w: 10 ** (states[c[1:]][1][w] if len(c) > 1 else root(w)) for w in below[c]}
        left, rest = max(1 - sum(up.values()), 1e-12), 1 - sum(below[c].values()) / size
        gain = sum(n / size * math.log(n / size / up[w]) for w, n in below[c].items()) + (rest * math.log(rest / left) if rest > 1e-12 else 0)
        if 2 * size * gain > len(up) + suffix_tree.DEVIATIONS * math.sqrt(2 * len(up)):
            smooth = {w: (n - suffix_tree.DISCOUNT) / size for w, n in below[c].items()}
            states[c] = (math.log10(max(1 - sum(smooth.values()), 1e-12) / left), {w: math.log10(x) for w, x in smooth.items()})
    return states, root


@pytest.mark.parametrize("shares", [(1e-4, 1e-6), (5e-2, 2e-2), (1.0, 1.0)])
def test_scores_are_those_of_the_whole_model(spark, shares, monkeypatch):
    """Contexts and words below every share of the corpus count, wherever they are held."""
    monkeypatch.setattr(suffix_tree, "CONTEXT_SHARE", shares[0])
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", shares[1])
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in np.cumsum(rng.integers(1, 3, 30)) * 7 % 23) for _ in range(120)]
    texts += [text for k in range(4) for text in [f"p{k} q r s{k}", f"z{k} r t{k}"] * 9] + [None, "", "w7 p1 q r s1 q r s2 z1 r s1", "never seen"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    states, root = _whole_model([t for i, t in enumerate(texts) if i % 9])
    assert max(map(len, states)) == suffix_tree.DEPTH and ("p1", "q", "r") in states
    want = []
    for text in texts:
        seen, total = ["<s>"], 0.0
        for w in [*(text or "").lower().split(), "</s>"]:
            for d in range(suffix_tree.DEPTH, -1, -1):
                state = states.get(tuple(seen[-d:])) if 0 < d <= len(seen) else None
                if d == 0:
                    total += root(w)
                elif state and w in state[1]:
                    total += state[1][w]
                    break
                elif state:
                    total += state[0]
            seen.append(w)
        want.append(total)
    tree, counts = suffix_tree.train(frame.where("doc_id % 9 > 0"))
    out = suffix_tree.score_texts(frame, tree, counts).toPandas().sort_values("doc_id")
    assert np.allclose(out["score"], want)
