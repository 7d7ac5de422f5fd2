import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwork.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_equal_the_tokenizer():
    texts = ["", " ", "a  b", "a\n b", "it's  the\t tab ", "x" * 300, "é ü 漢字 <|endoftext|> 12 345", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>b c", "a  <|endoftext|>  b", "<|endoftext|>", " <|endoftext|> ", "x\n<|endoftext|>\ny <|endoftext|", "a\u00a0 b \u2003c d\u3000", "a \n\n b", " lead", "trail ", "don't we'll\n\nI'd"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab'. \n\t1é") for _ in range(60)) for _ in range(300)]
    texts += [" ".join(rng.choice(("a", "b<|endoftext|>", "<|endoftext|>c", "", "\t", "d.")) for _ in range(8)) for _ in range(200)]
    words = packing._Words(PATH)
    for text, e in zip(texts, tokenizer().encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.tokenize(text), "<u4").tolist() == e.ids, text


@pytest.mark.parametrize("capacity", [1024, 32])
def test_pieces_and_places(odd_docs, odd_rows, capacity):
    found = packing.pack(odd_docs, PATH, capacity, 2).collect()
    expected = Counter()
    for i, text in odd_rows:
        ids = np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def best(sizes, capacity):
    """The least number of bins, by trying all placements."""
    sizes, least = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return least[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice((12, 20, 31))
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = Counter(sizes)
        fixed = packing.dominant_bins(counts, capacity)
        n = sum(times for _, times in fixed)
        assert n + best(list(counts.elements()), capacity) == best(sizes, capacity), sizes


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
