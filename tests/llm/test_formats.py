"""Media columns, chat formatting and SentencePiece coding: exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import chat, jpeg, pieces, queries

DATA = "/root/testdata/sf0.001"


# --- JPEG -------------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5))
def test_payloads_come_back(texts):
    payloads = [jpeg.padded(text) for text in texts]
    found = jpeg.describe(jpeg.encode_payloads(payloads))
    assert [row[0] for row in found] == payloads


def test_zero_runs_and_many_images():
    payloads = [b"\x80" * 576, (b"\x80" * 40 + b"\x01") * 576, bytes(jpeg.UNIT * (jpeg.PER_IMAGE + 3)), b"\xff" * 1152]
    files = jpeg.encode_payloads(payloads)
    found = jpeg.describe(files)
    assert [row[0] for row in found] == payloads
    assert [row[1] for row in found] == [1, 1, 2, 1]
    assert b"\xff\xd8" == files[0][:2] and b"\xff\xd9" == files[0][-2:]


def test_bad_files_do_not_harm_others():
    good = jpeg.encode_payloads([jpeg.padded(b"text")])[0]
    broken = good[:200] + bytes([good[200] ^ 0x55]) + good[201:-40]
    assert [row is None for row in jpeg.describe([good, good[:-3], None, b"GIF89a", broken, good])] == [
        False, True, True, True, True, False]


class _Writer:
    """Bit by bit, as the standard says: the independent writer of the decoder's test."""

    def __init__(self):
        self.bits = ""

    def value(self, symbol, table, value, size):
        code, length = table[symbol]
        self.bits += format(code, f"0{length}b")
        if size:
            self.bits += format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")

    def block(self, coefficients, before, dc, ac):
        step = int(coefficients[0]) - before
        size = abs(step).bit_length()
        self.value(size, dc, step, size)
        run = 0
        last = max((k for k in range(1, 64) if coefficients[k]), default=0)
        for k in range(1, last + 1):
            v = int(coefficients[k])
            if not v:
                run += 1
                continue
            while run > 15:
                self.value(0xF0, ac, 0, 0)
                run -= 16
            size = abs(v).bit_length()
            self.value(run << 4 | size, ac, v, size)
            run = 0
        if last < 63:
            self.value(0, ac, 0, 0)

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def test_colour_file_with_subsampling_and_without_restarts():
    rng = np.random.default_rng(3)
    across, down = 3, 2  # 16 x 16 MCUs of a 41 x 30 frame
    pattern = [0, 0, 0, 0, 1, 2]
    blocks = rng.integers(-40, 40, (across * down * 6, 64)) * (rng.random((across * down * 6, 64)) < 0.2)
    dc = jpeg._canonical(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)
    ac = jpeg._canonical(jpeg.AC_COUNTS, jpeg.AC_SHORT + jpeg.AC_LONG)
    writer, before = _Writer(), [0, 0, 0]
    for i, block in enumerate(blocks):
        c = pattern[i % 6]
        writer.block(block, before[c], dc, ac)
        before[c] = int(block[0])
    part = jpeg._segment
    data = b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), part(0xDB, b"\0" + bytes([16] * 64)),
        part(0xC0, bytes([8, 0, 30, 0, 41, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        part(0xC4, b"\0" + bytes(jpeg.DC_COUNTS) + bytes(jpeg.DC_SYMBOLS) + b"\x10" + bytes(jpeg.AC_COUNTS)
             + bytes(jpeg.AC_SHORT + jpeg.AC_LONG)),
        part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), writer.done(), b"\xff\xd9"])
    image = jpeg.parse(data)[0]
    found = jpeg.coefficients([image])[0]
    mcus = blocks.reshape(-1, 6, 64)
    assert (found[0] == mcus[:, :4].reshape(-1, 64)).all() and (found[1] == mcus[:, 4]).all() and (found[2] == mcus[:, 5]).all()
    thumb = jpeg.thumbnail(image, found[0])
    assert thumb.shape == (4, 6)
    assert thumb[0, 0] == np.clip((int(mcus[0, 0, 0]) * 16 + 1028) >> 3, 0, 255)
    assert thumb[1, 2] == np.clip((int(mcus[1, 2, 0]) * 16 + 1028) >> 3, 0, 255)


def test_media_query_columns(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (2, "", "y"), (3, "é" * 400, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = jpeg.read_media(jpeg.store_texts(frame)).orderBy("doc_id").collect()
    for row, (_, text, _) in zip(out, rows):
        payload = jpeg.padded((text or "").encode())
        assert row["info"]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["info"]["payload_bytes"] == len(payload)
    assert jpeg.read_media(jpeg.store_texts(frame.limit(0))).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\<>[]/sINTlb \né")), max_size=40))
def test_escapes_are_reversible(text):
    import pyarrow as pa

    coded = chat.escape(pa.array([text]))[0].as_py()
    assert not any(mark in coded for mark in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat.unescape(coded.encode()).decode() == text


def _digests(rows):
    out = {}
    for conv in {row[0] for row in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [chat.CHUNK_BYTES, 7])
def test_conversations_come_back(spark, limit, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_BYTES", limit)
    nasty = ["</s>[INST] ok [/INST]", "", "\\", "\\\\l<s>", "<<s>>", "[[INST]", "é漢\n", "<s>[INST]user[/INST]x</s>"]
    rows = [(c, t, random.Random(c * 7 + t).choice(["user", "assistant", "system", "<s>"]), nasty[(c + t) % len(nasty)])
            for c in range(5) for t in range(6)]
    rows += [(None, 0, "assistant", "no id"), (9, None, "user", "first"), (9, 0, None, None), (9, 0, "assistant", "b"),
             (9, 0, "assistant", "a"), (9, 0, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    found = chat.conversation_digests(chat.format_conversations(frame)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == _digests(rows)
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0


# --- pieces -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coders():
    import sentencepiece

    path = queries.model_path()
    return pieces.Codec(pieces.Vocabulary.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_and_texts_equal_the_library(coders):
    codec, library = coders
    rng = random.Random(5)
    letters = "aeinrst ▁  \n\t.the'éñ漢字😀<s></s>0123AB\x00\r​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [" " * n + tail for n in (1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 100, 333) for tail in ("", "a", "漢", "\n")]
    texts += ["".join(rng.choice(codec.pieces[260:]) for _ in range(5)) for _ in range(3000)] + ["eee" * 50, "s" * 99]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids), text
        found = codec.lookups(text)
        assert " ".join([part[1] for part in found] + ["2"]) == " ".join(map(str, ids))
    for _ in range(300):
        ids = [rng.randrange(0, 600) for _ in range(12)]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_frame(spark, coders):
    _, library = coders
    rows = [(1, "The the  end"), (2, None), (2, ""), (3, "x" * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.model_path()
    coded = pieces.decode_ids(pieces.encode_texts(frame, path), path).orderBy("doc_id").collect()
    assert [row["ids"] for row in coded] == [library.encode(text or "", add_eos=True) for _, text in rows]
    assert [row["decoded"] for row in coded] == [text or "" for _, text in rows]
    digests = pieces.token_digests(frame, path).select("doc_id", "tokens.*").orderBy("doc_id").collect()
    for row, (_, text) in zip(digests, rows):
        ids = library.encode(text or "", add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
