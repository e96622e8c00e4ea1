"""Near-duplicate documents, repeated lines and the pipeline against brute force."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from sightline.llm import lines, near, queries
from sightline.llm.common import connected_components, table

DATA = "/root/testdata/sf0.001"


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 300, 301: 300}


# --- near duplicates --------------------------------------------------------------------------------------------------

def brute_components(rows):
    """Component id of each row (id, text) by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    union = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                union.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            root = union.find(i)
            least[root] = min(least.get(root, key), key)
    return [(key, len(s), key if not s else least.get(union.find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def near_rows():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):  # copies of one text with ever more changed words: links, chains and strangers
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((1001 + i, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, f"{passage} " + " ".join(rng.choice(vocabulary) for _ in range(20 + i * 3))) for i in range(40)]
    for n in range(1, 12):  # short texts around the limits of the sketch and of the shingle
        words = [f"s{n}x{k}" for k in range(n)]
        rows += [(3000 + 10 * n + k, " ".join(words[: n - k])) for k in range(3)]
    rows += [(4000, "Same Text here now ok five"), (4001, "same text HERE now\tok  five"), (4001, "same text here now ok five"), (4002, None),
             (4003, ""), (4004, " \n\t"), (None, "same text here now ok five"), (None, "all alone in the world today"), (4005, "Ünï"), (4006, "ünï")]
    rows += [(5000 + i, " ".join(f"l{k}" for k in range(i, i + 40))) for i in range(0, 60, 2)]  # a long chain
    return rows


@pytest.mark.parametrize("block", [1024, 40])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCUMENTS", block)
    rows = near_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    found = near.near_duplicates(frame).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key)
    assert got == sorted(brute_components(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    found = queries.QUERIES["op3_near"](spark, DATA).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(rows))


def test_forest_of_large_groups_equals_pairwise_links():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 150).astype(np.uint64))
    sets = []
    for _ in range(300):
        keep = base[rng.random(len(base)) > rng.random() * 0.3]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)])))
    one, two = Union(len(sets)), Union(len(sets))
    for a, b in near.links_of(sets):
        one.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                two.join(i, j)
    same = lambda u: [u.find(i) == u.find(j) for i in range(len(sets)) for j in range(i)]
    assert same(one) == same(two)


def test_one_document_of_each_group(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, ""), (None, "x y z"), (5, "x y z")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, mark string")
    out = sorted((str(r["doc_id"]), r["text"]) for r in near.one_of_each(frame).collect() if r["text"])
    assert out == [("1", "a b c d e f"), ("5", "x y z")]
    assert near.one_of_each(frame).where("coalesce(text, '') = ''").count() == 3
    assert near.one_of_each(frame).columns == frame.columns
    assert near.one_of_each(frame.limit(0)).count() == 0


# --- lines ------------------------------------------------------------------------------------------------------------

def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _simhash(words):
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words], dtype=np.uint64)
    votes = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return int(sum(1 << b for b in range(lines.BITS) if 2 * int(votes[b]) > len(words)))


def _coded(norm):
    return [_signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) % 0x9000 for w in norm.split(" ")]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    """Text of each row without repeated lines."""
    import re

    where = collections.defaultdict(list)
    for key, text in rows:
        if text is not None:
            mark = _signed(xxhash.xxh64_intdigest(text.encode(), seed=42))
            for pos, line in enumerate(text.split("\n")):
                norm = re.sub(lines.GAPS, " ", line.lower()).strip(" ")
                if norm.count(" ") >= lines.MIN_WORDS - 1:
                    where[norm].append((key is None, key or 0, mark, pos))
    listed = list(where)
    sims = [_simhash(norm.split(" ")) for norm in listed]
    union = Union(len(listed))
    for i in range(len(listed)):
        for j in range(i):
            if (sims[i] ^ sims[j]).bit_count() <= lines.DISTANCE:
                a, b = _coded(listed[i]), _coded(listed[j])
                if _edits(a, b) <= max(len(a), len(b)) * (100 - lines.SIMILARITY) // 100:
                    union.join(i, j)
    best = {}
    for i, norm in enumerate(listed):
        root = union.find(i)
        best[root] = min([*where[norm], *([best[root]] if root in best else [])])
    index = {norm: i for i, norm in enumerate(listed)}
    drop = {o for norm, all_ in where.items() for o in all_ if o != best[union.find(index[norm])]}
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None))
            continue
        mark = _signed(xxhash.xxh64_intdigest(text.encode(), seed=42))
        out.append((key, "\n".join(l for p, l in enumerate(text.split("\n")) if (key is None, key or 0, mark, p) not in drop)))
    return out, len(drop)


def line_rows():
    rng = random.Random(8)
    line = " ".join(rng.choice("alpha beta gamma delta rho sigma tau".split()) + str(i % 3) for i in range(60))
    rows = []
    for i in range(60):
        words = line.split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] += rng.choice("xyz")
        rows.append((i % 50, "\n".join([f"own line number of the document zz{'q' * i} here", " ".join(words), "Yes.", "Yes."])))
    long_line = " ".join(f"{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'uvw'[i // 7 % 3]}" for i in range(700))
    rows += [(70, long_line), (71, long_line + " tail"), (72, None), (73, ""), (None, line), (None, long_line.upper()), (74, f"{line}\n{line}\r\n{line}!"),
             (75, "the same five words here\nThe same; five words here 12"), (75, "the same five words here\nThe same; five words here 12"), (76, "é à ü ö ñ\né à ü ö ñ")]
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, line int")
    want, dropped = brute_lines(rows)
    found = lines.dedup_lines(frame).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert order([(r["doc_id"], r["text"]) for r in found]) == order(want)
    assert dropped > 50
    assert lines.dedup_lines(frame.limit(0)).count() == 0


def test_lines_leave_other_columns_alone(spark):
    names = ["__id", "__cut", "__at", "__mark", "id", "mark", "pos", "cut", "row", "at", "line", "block"]
    row = "five words are enough here"
    frame = spark.createDataFrame([(i, *[f"{name}{i}" for name in names], f"{row}\nother{i}", "old") for i in range(3)],
                                  ["doc_id", *names, "text", "line_info"])
    found = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    assert [found[i]["text"] for i in range(3)] == [f"{row}\nother0", "other1", "other2"]
    assert all(found[i][name] == f"{name}{i}" for i in range(3) for name in names) and found[1]["line_info"]["n_dropped"] == 1


def test_lines_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").where("doc_id % 2 = 0").collect()]
    frame = table(spark, DATA, "documents").where("doc_id % 2 = 0")
    found = lines.dedup_lines(frame)
    assert "localCheckpoint" not in found._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted(brute_lines(rows)[0])


def test_every_pair_of_lines_within_the_edit_limit_is_found(spark):
    """Recall against edit similarity alone, where SimHashes are many bits apart."""
    rng = random.Random(5)
    rows, changed = [], []
    for i, n in enumerate([9, 10, 11, 18, 19, 20, 30, 50, 100, 205] * 12):
        words = [f"{rng.choice('abcdefgh')}{''.join(rng.choice('xyzuvw') for _ in range(6))}" for _ in range(n)]
        copy = list(words)
        for _ in range(n // 10):
            at, how = rng.randrange(len(copy)), rng.randrange(3)
            copy[at: at + (how != 1)] = [] if how == 0 and n % 10 else ["new" + rng.choice("pqrst") * 3]
        if n == 9:
            copy.insert(rng.randrange(10), "added")
        near = _edits(words, copy) <= max(len(words), len(copy)) // 10
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        changed += [2 * i + 1] if near else []
    rows += [(9000, "b " * 30), (9001, "b " * 27), (9002, "c " * 9 + "d"), (9003, "c " * 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(frame).collect() if r["line_info"]["n_dropped"]}
    assert gone == {*changed, 9001, 9003} and len(changed) > 100


# --- pipeline ---------------------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    docs = table(spark, DATA, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near", "mixing", "pieces"]
    previous = docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, previous, DATA).toPandas()
        held[name] = out
        if name != "pieces":
            assert list(out.columns) == docs.columns
            previous = spark.createDataFrame(out, docs.schema)
    first = docs.toPandas()
    assert len(held["language"]) >= 0.97 * len(first)
    want = {k: t for k, t in brute_lines(list(zip(held["language"]["doc_id"], held["language"]["text"])))[0] if t.split()}
    got = dict(zip(held["lines"]["doc_id"], held["lines"]["text"]))
    assert got == want and (held["lines"]["n_chars"] == held["lines"]["text"].str.len()).all()
    components = brute_components(list(zip(held["lines"]["doc_id"], held["lines"]["text"])))
    assert sorted(held["near"]["doc_id"]) == sorted(k for k, n, c in components if k == c)
    assert set(held["mixing"]["doc_id"]) <= set(held["near"]["doc_id"])
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    sizes = dict(zip(held["pieces"]["doc_id"], held["pieces"]["n_tokens"]))
    assert sizes == {k: len(library.encode(t, add_eos=True)) for k, t in zip(held["mixing"]["doc_id"], held["mixing"]["text"])}
    assert isinstance(held["pieces"], pd.DataFrame)
