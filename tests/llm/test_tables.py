"""Resharding, whitening and spelling variants against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import queries, resharding, variants, whitening
from sightline.llm.common import table
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


# --- resharding -------------------------------------------------------------------------------------------------------

def cheapest(sizes, room, cost):
    """Least cost of placing the sizes, by trying all whole flows."""
    best = {tuple(room): 0}
    for i, size in enumerate(sizes):
        further = {}
        for free, paid in best.items():
            for amounts in itertools.product(*[range(min(size, f) + 1) for f in free]):
                if sum(amounts) == size:
                    left = tuple(f - a for f, a in zip(free, amounts))
                    price = paid + sum(a * cost(i, j) for j, a in enumerate(amounts))
                    further[left] = min(price, further.get(left, price))
        best = further
    return min(best.values())


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(0, 4) for _ in range(rng.randint(1, 3))]
        room = resharding.capacities(sum(sizes) + rng.randint(0, 2), rng.randint(1, 4))
        price = [[rng.randint(0, 3) for _ in room] for _ in sizes]
        for cost in (lambda i, j: int(i != j), lambda i, j: price[i][j]):
            flow = resharding.minimum_cost_flow(dict(enumerate(sizes)), dict(enumerate(room)), cost)
            assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(len(sizes))] == sizes
            assert all(sum(a for (_, j), a in flow.items() if j == k) <= room[k] for k in range(len(room)))
            assert sum(a * cost(i, j) for (i, j), a in flow.items()) == cheapest(sizes, room, cost)
    with pytest.raises(ValueError):
        resharding.minimum_cost_flow({0: 5}, {0: 4})


def shard_rows(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), 0 if i % 3 else i % 5) for i in range(900)]
    rows += [(2000, "é" * 3000, 1), (2001, None, 2), (2002, "", None), (None, "no key", 3), (None, None, None), (7, "again", 1), (7, "again", 1)]
    return spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, home int, shard string, file int")


def test_shards_are_even_whole_and_numbered(spark):
    rows = shard_rows(spark)
    found = resharding.reshard(rows, F.col("home"), 4, file_bytes=20_000)
    assert found.columns == [*rows.columns, "placed"]
    held = found.toPandas()
    placed = held["placed"].map(lambda r: r.asDict()).apply(lambda d: d)
    plain = sorted(map(repr, rows.toPandas().itertuples(index=False, name=None)))
    assert sorted(map(repr, held.drop(columns="placed").itertuples(index=False, name=None))) == plain
    sizes = {k: sum(p["size"] for p in placed if p["shard"] == k) for k in range(4)}
    assert max(sizes.values()) - min(sizes.values()) < 2 * 301
    for k in range(4):
        assert sorted(p["slot"] for p in placed if p["shard"] == k) == list(range(sum(p["shard"] == k for p in placed)))
    assert all(p["size"] == len((t or "").encode()) + 1 for p, t in zip(placed, held["text"].where(held["text"].notna(), None)))
    before = {k: sum(p["size"] for p in placed if p["old"] == k) for k in range(5)}
    least = sum(before.values()) - sum(min(before[k], sum(before.values()) / 4) for k in range(4))
    moved = sum(p["size"] for p in placed if p["moved"])
    assert least * 0.99 - 400 <= moved <= least * 1.01 + 400
    assert resharding.reshard(rows.limit(0), F.col("home"), 4).count() == 0


def test_only_affected_files_are_written(spark, tmp_path):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t" * 9).alias("text"),
                                    F.when(F.col("id") < 100, 0).when(F.col("id") < 200, 1).otherwise(2).cast("int").alias("shard"))
    folder = str(tmp_path / "table")
    frame.write.partitionBy("shard").parquet(folder)
    where = resharding.reshard_folder(spark, folder, 4)
    assert [number for number, path in where.items() if path.startswith(folder + "/")] == [0, 1]
    counts = {number: spark.read.parquet(path).count() for number, path in where.items()}
    assert sum(counts.values()) == 400 and all(abs(n - 100) <= 1 for n in counts.values())
    again = resharding.reshard_folder(spark, folder, 3, room={0: 1000, 1: 1000, 2: 2000})
    assert all(path.startswith(folder + "/") for path in again.values())  # nothing has to move


# --- whitening --------------------------------------------------------------------------------------------------------

def test_components_equal_a_full_decomposition(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 40)) * np.linspace(3, 0.1, 40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0] + 5
    rows = [(i, [float(v) for v in vector], i) for i, vector in enumerate(base)]
    rows += [(900, None, 0), (901, [1.0] * 39 + [None], 0), (902, [1.0] * 39 + [float("nan")], 0), (903, [float("inf")] * 40, 0),
             (904, [], 0), (905, [1.0, 2.0], 0), (5, rows[5][1], 0), (None, rows[6][1], 0)]
    frame = spark.createDataFrame([(*r, "u") for r in rows], "vec_id long, embedding array<double>, x long, row string")
    found = whitening.whiten(frame).toPandas()
    assert len(found) == 302 and {"x", "row", "white"} <= set(found.columns)
    x = np.floor(np.stack(found["embedding"].to_numpy()) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - sums / n) @ vectors[:, :8] / np.sqrt(values[:8])
    got = np.stack([r["values"] for r in found["white"]])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    assert [r["deviation"] for r in found["white"]] == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    first = found["white"][0]
    assert np.allclose(first["explained"], values[:8] / values.sum(), rtol=1e-9) and first["identity_error"] < 1e-9 and first["n"] == n


def test_whitening_of_small_and_flat_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    equal = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], schema)).collect()
    assert [(r["white"]["values"], r["white"]["deviation"]) for r in equal] == [([], 0)] * 3
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert all(len(r["white"]["values"]) == 1 for r in line)  # rank 1
    assert abs(sum(r["white"]["values"][0] ** 2 for r in line) / 5 - 1) < 1e-9
    assert whitening.deviation(np.array([[10**15, 0]]), 10**6, [0, 0]) == [10**42]
    huge = whitening.whiten(spark.createDataFrame([(0, [1e15]), (1, [-1e15])], "vec_id long, embedding array<double>")).collect()
    assert [r["white"]["deviation"] for r in huge] == [None, None]


def test_filter_converges_where_the_spectrum_is_flat(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 60))
    frame = spark.createDataFrame([(np.floor(v * 1024).astype(int).tolist(),) for v in base], "x array<bigint>")
    model = whitening.fit(frame)
    assert model.residual <= 1e-12 and model.passes < 200 and len(model.values) == 8


# --- spelling variants ------------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts, ratio=5):
    form = {}
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] > 0 else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 5, 10, 50, 250, 251]) for _ in range(300)}
    words |= {"": 4, "ABC": 3, "😀abc": 7, "😀abd": 40, "abd": 1000, "漢字abc": 9, "zero": 0, "zer": 5}
    rows = [(w, n, 1) for w, n in words.items()] + [(None, 5, 1), ("", None, 1), ("abd", 2, 1)]
    words["abd"] += 2
    frame = spark.createDataFrame(rows, "word string, n long, other long")
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.variant_groups(frame).collect()}
    assert found == brute_variants(words)
    assert any(r[2] != r[4] and r[2] for r in found.values())  # a chain of forms
    assert variants.variant_groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.variant_groups(frame, ratio=1)


def test_slips_and_letters(spark):
    docs = spark.createDataFrame([(1, "Ab-ÀÉ×÷ x1Y\n"), (2, None), (3, ""), (None, "Zed")], "doc_id long, text string")
    runs = docs.select("doc_id", F.explode(variants.letter_runs(F.col("text"))).alias("run"))
    assert sorted(r["run"] for r in runs.collect()) == ["ab", "x", "y", "zed", "ÀÉ×÷"]
    many = spark.createDataFrame([(i, "spellingé") for i in range(2000)] + [(None, "spellingé")], "doc_id long, run string")
    got = sorted(r["word"] for r in variants.with_slips(many, "doc_id").collect())
    want = []
    for key in [*range(2000), ""]:
        h = zlib.crc32(f"{key}:spellingé".encode())
        want.append("spellingé"[: h % 9] + "spellingé"[h % 9 + 1:] if h % 199 == 0 else "spellingé")
    assert got == sorted(want) and len(set(got)) > 3


@pytest.mark.parametrize("name", ["op11_shards", "op13_variants"])
def test_queries_equal_their_twins(spark, name):
    problem, _ = compare(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLE_SQL[name])
    assert problem is None, problem


def test_whitening_query(spark):
    found = queries.QUERIES["op12_whitening"](spark, DATA).toPandas()
    assert len(found) == 8 * table(spark, DATA, "embeddings").count() and found["identity_error"].nunique() == 1
    assert found["identity_error"].max() < 1e-9 and sorted(found["component"].unique()) == list(range(1, 9))


def test_suffix_tree_leaves_no_stage_that_nothing_reads(spark):
    import os

    from sightline.llm import suffix_tree
    from sightline.session import recovery_directory

    folder = recovery_directory(spark).removeprefix("file:")
    texts = spark.createDataFrame([(i, f"a b c d a b c {'d e' if i % 2 else 'f g'}") for i in range(40)], "doc_id long, text string")
    before = set(os.listdir(folder))
    tree, counts = suffix_tree.train(texts)
    # The counts of words, the placed words and what runs are worth; the runs and states of each depth are gone.
    assert len(set(os.listdir(folder)) - before) == 3
    out = suffix_tree.score_texts(texts, tree, counts).collect()
    assert len(out) == 40 and all(row.score > row.base_score for row in out)
