"""Words and runs of the suffix tree: hashing of whole batches, look-up tables, what is shuffled."""

import numpy as np
import pyarrow as pa

from sightline.llm import suffix_tree


def test_words_are_split_and_hashed_as_one_by_one():
    texts = [b"The cat\tTHE cat ", None, b"", b" \n\x0b", b"end", b"end\xc3\x89x " + b"y" * 5000, b"12345678 123456789 abcdefgh abcdefghi" + b"y" * 5000]
    for column in (pa.array(texts, pa.binary()), pa.array([b"left out", *texts], pa.large_binary())[1:]):
        found, lengths = suffix_tree.hashes_of(column)
        words = [word for text in texts for word in (text or b"").lower().split()]
        assert lengths.tolist() == [len((text or b"").split()) for text in texts] and len(found) == len(words)
        alone = {word: suffix_tree.hashes_of(pa.array([word]))[0][0] for word in words}
        assert found.tolist() == [alone[word] for word in words] and len(set(alone.values())) == len(alone)


def test_places_of_keys_that_share_slots():
    keys = np.concatenate([np.arange(50) << 40, np.arange(1, 50)]).astype(np.int64)
    places = suffix_tree.Places(keys)
    assert places(keys).tolist() == list(range(99))
    assert set(places(np.array([-1, 50, 1 << 60])).tolist()) == {-1} and suffix_tree.Places(keys[:0])(keys).max() == -1


def test_runs_are_shuffled_in_blocks(spark, monkeypatch):
    plans, real = [], suffix_tree.stored

    def noted(frame, *args, **kwargs):
        plans.append((frame.columns, frame._jdf.queryExecution().executedPlan().toString()))
        return real(frame, *args, **kwargs)

    monkeypatch.setattr(suffix_tree, "stored", noted)
    suffix_tree.train(spark.createDataFrame([(i, "a b c d a b c e") for i in range(40)], "doc_id long, text string"))
    runs = [plan for columns, plan in plans if columns == ["ctx", "suf", "n", "key"]]
    assert len(runs) == suffix_tree.DEPTH and all("hashpartitioning(part" in plan and "hashpartitioning(ctx" not in plan for plan in runs)
