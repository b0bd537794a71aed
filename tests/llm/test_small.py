"""Spark-free helpers against plain versions."""

import random

import numpy as np
import pytest

from mcqlab.llm import jpeg, order_minhash, packing, sentence_pieces, token_counts
from mcqlab.llm import features as ft


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_banded_edit_distance_equals_the_full_table():
    r = random.Random(3)
    for _ in range(1500):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 30))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.randint(0, 6))
        k, d = r.randint(0, 12), levenshtein(a, b)
        assert order_minhash.edit_distance(a, b, k) == (d if d <= k else k + 1)


def test_order_minhash_keeps_order():
    w = np.arange(1, 400, dtype=np.uint32) * 7919
    g = order_minhash.shingles(w)
    assert (order_minhash.sketches(g) == order_minhash.sketches(g.copy())).all()
    turned = np.concatenate([g[200:], g[:200]])  # the same set in another order
    assert (order_minhash.sketches(g) == order_minhash.sketches(turned)).mean() < 0.7
    assert order_minhash.aligned(g, turned)[0] is False
    twice = np.array([5, 5, 7, 5], np.uint64)
    assert len(set(order_minhash.labelled(twice).tolist())) == 4


def test_sketches_in_pieces_equal_those_at_once(monkeypatch):
    g = order_minhash.shingles(np.random.default_rng(0).integers(0, 2**32, 900, dtype=np.uint32))
    whole = order_minhash.sketches(g)
    monkeypatch.setattr(order_minhash, "PIECE", 100)
    assert (order_minhash.sketches(g) == whole).all()


def test_words_of_texts():
    texts = ["Été, one two", "", "one-two  ONE", "été"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, s, e, at = ft.words(data, offsets)
    got = [[bytes(data[a:b]).lower() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(at[:-1], at[1:])]
    assert [len(g) for g in got] == [3, 0, 3, 1]
    assert h[1] == h[3] == h[5] and h[2] == h[4]


def test_segment_tree_after_edits():
    table, r, letters = token_counts.counts(token_counts.RANKS), random.Random(1), "ab  \n\t'st'ré!1,. "
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 50, 700])))
        tree = token_counts.SegmentTree(text, table)
        for _ in range(4):
            a = r.randint(0, len(text))
            b, new = min(len(text), a + r.choice([0, 1, 3, 40])), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 9])))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert "".join(tree.leaves) == text
            if r.random() < 0.3:
                tree = token_counts.SegmentTree(text, table, (tree.lengths[0], tree.sums[0]))
            assert tree.total == len(table.encoding.encode_ordinary(text))


def test_an_edit_recounts_only_its_region():
    tree = token_counts.SegmentTree("word " * 20000, token_counts.counts(token_counts.RANKS))
    tree.replace(50_000, 50_004, "other")
    assert 0 < tree.encoded < 300


def test_batched_passes_equal_single_ones():
    one, many, r = sentence_pieces.Pieces(), sentence_pieces.Pieces(), random.Random(9)
    chunks = {"".join(r.choice("   theingsoéxßZ.,19") for _ in range(r.randint(1, 32))) for _ in range(2000)}
    many.learn(chunks)
    assert len(many) > 1500 and all(one[c] == v for c, v in many.items())


def test_n_best_paths_equal_exhaustive_ones():
    p, r = sentence_pieces.Pieces(), random.Random(2)
    for _ in range(150):
        text = "".join(r.choice("the  ing\nsé▁①a") for _ in range(r.randint(1, 25)))
        edges, best = p.edges(" " + text), [[(0.0, ())]]
        for here in edges[1:]:
            best.append(sorted(((b + s, i + ids) for start, s, ids in here for b, i in best[start]), key=lambda x: -x[0])[:4])
        (chunks,) = p.split([text])
        found = p.encode(chunks)
        assert [s for s, _ in found] == [s for s, _ in best[-1]]
        assert all(p.decode(ids) == text for _, ids in found) and len({ids for _, ids in found}) == len(found)


def test_best_segmentation_of_natural_words_is_mostly_that_of_the_merges():
    from sentencepiece import SentencePieceProcessor

    model, p = SentencePieceProcessor(model_file=sentence_pieces.MODEL), sentence_pieces.Pieces()
    text = (
        "The quick brown fox jumps over the lazy dog and hello world is printed by the program that nobody maintains anymore. Information retrieval systems "
        "are evaluated with precision and recall measurements over benchmark collections. La connaissance des langues étrangères facilite les échanges."
    )
    same = [np.frombuffer(p.encode(p.split([w])[0])[0][1], "<u4").tolist() == model.encode(w) for w in text.split()]
    assert np.mean(same) > 0.9
    own, library = len(p.encode(p.split([text])[0])[0][1]) // 4, len(model.encode(text))
    assert own <= library


@pytest.mark.parametrize("units", [1, 2, 5, 257])
def test_jpeg_round_trip(units, monkeypatch):
    payload = np.random.default_rng(units).integers(0, 256, units * jpeg.UNIT, dtype=np.uint8)
    media = jpeg.store(payload)
    fast = jpeg.decode(media)
    assert (jpeg.payload_of(fast) == payload).all()
    assert jpeg.rgb(fast).shape == (fast.height, fast.width, 3)
    if units < 6:  # the same stream, symbol by symbol
        monkeypatch.setattr(jpeg, "_regular", lambda *a: False)
        slow = jpeg.decode(media)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.parts, slow.parts))


def test_jpeg_values_stay_in_range():
    payload = np.tile(np.array([255] * 192 + [0] * 192, np.uint8), 400)
    assert max(abs(c.coefficients).max() for c in jpeg.decode(jpeg.store(payload)).parts) <= 511


def test_chroma_is_upsampled():
    y = jpeg.Component(1, 2, 2, 0, np.zeros((2, 2, 64), np.int32))
    cb, cr = (jpeg.Component(k, 1, 1, 0, np.zeros((1, 1, 64), np.int32)) for k in (2, 3))
    cr.coefficients[0, 0, 0] = 8 * 50
    pixels = jpeg.rgb(jpeg.Picture(16, 16, [y, cb, cr], {0: np.ones(64, np.int32)}, []))
    assert pixels.shape == (16, 16, 3) and (pixels == [198, 92, 128]).all()


def test_word_ids_equal_the_tokenizers():
    b = packing.WordBpe()
    for t in ["It's <|endoftext|> ok", "naïve ½ x² _a_ 'S ΑΣ", "İstanbul \x1c a", "", "  ", "áé l'l've", "日本 語", "a\u00a0b 12_3!!"]:
        assert b.whole.encode(t, add_special_tokens=False).ids == np.frombuffer(b.encode(t), "<u4").tolist()


def test_vector_packing_keeps_its_limits():
    rng = np.random.default_rng(0)
    tokens = np.concatenate([rng.integers(1, 1000, 300), rng.integers(1, 20, 900)])
    demands, limits = np.stack([tokens, rng.integers(0, tokens + 1)], 1), np.array([1000, 6, 700])
    stopped = set()
    for cut in (True, False):
        d = demands if cut else np.minimum(demands, [1000, 700])
        done = packing.dot_product_packing(d, limits, may_cut=cut)
        parts = {}
        for own in done:
            used = [sum(n for _, _, n in own), len(own), sum(max(0, s + n - max(s, d[i, 0] - d[i, 1])) for i, s, n in own)]
            assert (used <= limits).all()
            stopped |= {k for k in range(3) if used[k] == limits[k]}
            for i, start, n in own:
                parts.setdefault(i, []).append((start, n))
        for i, own in parts.items():
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
            assert at == d[i, 0]
    assert stopped == {0, 1, 2}  # each limit stops some sequence
    cut = packing.powers_of_two([(0, 0, 5), (1, 0, 6)])
    assert [sum(n for _, _, n in own) for own in cut] == [8, 2, 1]
