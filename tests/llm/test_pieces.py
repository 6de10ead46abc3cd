import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tallyforge.llm import pieces
from tallyforge.llm.pieces import SPACE

from .corpus import documents, empty, rows, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def brute(m, text):
    """The whole lattice at once, as plain dynamic programming."""
    best = [(0.0, None, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - m.longest), end):
            part = text[start:end]
            if best[start] is None:
                continue
            if part in m.ids:
                new = (best[start][0] + m.ids[part][1], start, m.ids[part][0])
            elif end == start + 1:
                new = (best[start][0] + m.unknown_score, start, m.unknown)
            else:
                continue
            if best[end] is None or new[0] > best[end][0]:
                best[end] = new
    out, end = [], len(text)
    while end:
        _, start, i = best[end]
        out += [m.bytes[b] for b in reversed(text[start:end].encode())] if i == m.unknown else [i]
        end = start
    return out[::-1]


def test_encoding_against_the_whole_lattice(model):
    for t in texts():
        t = (t or "")[:1500]
        assert list(model.encode(t)) == (brute(model, SPACE + t.replace(" ", SPACE)) if t else [])


@pytest.mark.parametrize("seed", range(6))
def test_streaming_over_text_without_spaces(model, seed):
    rng = random.Random(seed)
    t = "".join(rng.choice("abetionsrlu") for _ in range(3000))
    parts = list(model.segment(t))
    assert [i for p in parts for i in p] == brute(model, t)
    assert len(parts) > 20 and max(map(len, parts)) < 400  # committed on the way, not at the end


@pytest.mark.parametrize("unit", ["a", "ab", "abc", "the", "entertain", "=", "-=", "吃葡萄不吐葡萄皮", "的", "ha"])
def test_periodic_text_holds_a_bounded_window(unit):
    held = []
    for times in (3000, 30_000):
        m = pieces.Model(PATH)
        text = (unit * times)[:30_000 if times > 3000 else 3000]
        got = [i for part in m.segment(text) for i in part]
        assert m.decode(np.array(got)) == text.replace(SPACE, " ")
        if times == 3000:
            assert got == brute(m, text)
        held.append(m.held)
    assert max(held) < 40 * m.longest and held[1] <= held[0] + m.longest


@pytest.mark.parametrize("seed", range(20))
def test_folding_changes_nothing(seed, monkeypatch):
    monkeypatch.setattr(pieces, "FOLD", 1)
    m = pieces.Model(PATH)
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "aa", "ab", "abab" * rng.randint(1, 60), "aaaa" * rng.randint(1, 60), "e"]) for _ in range(60))
    assert [i for part in m.segment(text) for i in part] == brute(m, text)


@pytest.mark.parametrize("seed", range(50))
def test_folded_blocks_unfold(seed):
    rng = random.Random(seed)
    blocks, ids = [], []
    for _ in range(8):
        more = [rng.randint(1, 2) for _ in range(rng.randint(0, 4))] * rng.randint(1, 9)
        blocks = pieces.folded(blocks, more)
        ids += more
        assert [i for block, times in blocks for _ in range(times) for i in block] == ids


def test_chinese_without_spaces(model):
    rng = random.Random(5)
    text = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经") for _ in range(5000))
    assert [i for part in model.segment(text) for i in part] == brute(model, text)


def test_round_trip_and_the_librarys_decoder(model):
    file = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts():
        if t:
            ids = model.encode(t)
            assert model.decode(ids) == t == file.decode(ids.tolist())


def test_remembered_words_change_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    small = pieces.Model(PATH)
    for t in texts():
        assert list(small.encode(t or "")) == list(model.encode(t or ""))


def test_decode_refuses_foreign_ids(model):
    with pytest.raises(ValueError, match="outside"):
        model.decode(np.array([10**6]))


def test_report_and_frames(spark, model):
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in pieces.report(documents(spark)).collect())
    want = []
    for r in rows():
        ids = model.encode(r[1] or "")
        want.append((str(r[0]), len(ids), zlib.crc32(ids.tobytes()), len((r[1] or "").encode()), True))
    assert got == sorted(want)
    coded = pieces.encode(documents(spark))
    assert sorted((str(r[0]), r[1]) for r in pieces.decode(coded).collect()) == sorted((str(r[0]), r[1] or "") for r in rows())


def test_empty(spark):
    assert pieces.report(empty(spark)).count() == 0 and pieces.decode(pieces.encode(empty(spark))).count() == 0
