"""The operators' kernels against plain versions, without Spark."""

import base64
import os
import random
import subprocess
import sys

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scorewatch.llm import bpe, decontaminate, quality, simhash, suffixes, toxicity, warc, winnow

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, texts):
    found = list(codec.encode([t.encode() for t in texts]))
    assert all(codec.spell(ids).decode() == " ".join(map(str, ids)) for ids in found)
    return [ids.tolist() for ids in found]


def test_bpe_equals_the_library_on_mixed_text(codec, library):
    draw = random.Random(1)
    letters = " \n\t'sstmdrvlee're'll xYZ09é٣漢!?.  \x1c\x85 "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n\n x", " 's", "a" * 700, "ab" * 400 + " " * 300, "don't we'll 'tis 's's ''s 're"]
    assert ids_of(codec, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_bpe_equals_the_library_on_any_text(codec, library, texts):
    got = ids_of(codec, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(i, dtype=np.int32)).decode() for i in got] == texts


def test_scan_equals_a_loop():
    finder = bpe.PieceFinder()
    draw = np.random.default_rng(2)
    numbers = draw.integers(0, len(finder.compose), 5000).astype(np.uint16)
    state, want = 0, []
    for n in numbers.tolist():
        want.append(state)
        state = int(finder.compose[state, n])
    assert bpe.prefix_functions(numbers, finder.compose).tolist() == want


def plain_winnow(text, gram, window):
    points = [ord(c) for c in text]
    if not points:
        return []
    gram = min(gram, len(points))
    hashes = [int(winnow.rolling(np.array(points[i : i + gram], dtype=np.uint32), gram)[0]) for i in range(len(points) - gram + 1)]
    kept = []
    for s in range(max(1, len(hashes) - window + 1)):
        part = hashes[s : s + window]
        at = s + max(j for j, h in enumerate(part) if h == min(part))
        if (min(part), at) not in kept:
            kept.append((min(part), at))
    return kept


def test_winnowing_equals_the_definition():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("abé漢") for _ in range(draw.randint(0, 80)))
        gram, window = draw.randint(1, 6), draw.randint(1, 9)
        hashes, at = winnow.winnow(text, gram, window)
        assert list(zip(hashes.tolist(), at.tolist())) == plain_winnow(text, gram, window)


def test_winnowing_guarantee():
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    for _ in range(50):
        passage = word(winnow.GRAM + winnow.WINDOW - 1)
        one, other = word(200) + passage + word(50), word(31) + passage + word(170)
        assert set(winnow.winnow(one)[0].tolist()) & set(winnow.winnow(other)[0].tolist())


def test_bk_tree_finds_all_within_the_radius():
    draw = random.Random(5)
    values = [draw.getrandbits(64) for _ in range(200)]
    values = list(dict.fromkeys(values + [v ^ 1 << draw.randrange(64) for v in values]))
    tree = simhash.BKTree(values)
    for value in values[:60]:
        for radius in (0, 2, 25):
            assert sorted(tree.within(value, radius)) == [i for i, x in enumerate(values) if (x ^ value).bit_count() <= radius]


def test_fingerprint_bits_are_majorities():
    import xxhash

    words = b"a b c d a b c".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert int(simhash.majority(simhash.shingle_digests(b"A b\tC  d\na b c", 3)).hex(), 16) == want
    assert simhash.majority(simhash.shingle_digests(b" \n", 3)) == bytes(8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40), st.sampled_from([0, 2, 5, 50]))
def test_deep_shallow_sorts_with_common_prefixes(strings, limit):
    order, prefix = suffixes.deep_shallow(strings, 0, limit)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    assert prefix == [-1] + [suffixes.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def plain_tiles(item, text, least):
    """Greedy string tiling by its definition."""
    item_free, text_free, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and item_free[i + n] and text_free[t + n]:
                    n += 1
                if n > best[2]:
                    best = (i, t, n)
        if best[2] < least:
            return tiles
        i, t, n = best
        tiles.append(best)
        item_free[i : i + n] = text_free[t : t + n] = [False] * n


def test_tiling_covers_as_much_as_the_definition():
    draw = random.Random(6)
    for _ in range(300):
        item = [draw.randrange(4) for _ in range(draw.randint(5, 40))]
        text = [draw.randrange(5) for _ in range(draw.randint(5, 60))]
        if draw.random() < 0.5:
            cut = draw.randrange(len(item))
            text = text[:10] + item[cut:] + text[10:] + item[:cut]
        got = decontaminate.greedy_tiles(np.array(item), np.array(text), 3)
        want = plain_tiles(item, text, 3)
        assert sorted(n for *_, n in got)[-1:] == sorted(n for *_, n in want)[-1:]
        for i, t, n in got:
            assert item[i : i + n] == text[t : t + n] and n >= 3
        places = [p for i, _, n in got for p in range(i, i + n)], [p for _, t, n in got for p in range(t, t + n)]
        assert all(len(set(p)) == len(p) for p in places)
        free_item = [x if p not in places[0] else -1 for p, x in enumerate(item)]
        free_text = [x if p not in places[1] else -2 for p, x in enumerate(text)]
        assert not plain_tiles(free_item, free_text, 3)


def test_block_max_search_equals_a_full_scan():
    draw = random.Random(7)
    vectors = []
    for _ in range(500):
        v = {draw.randrange(30): draw.random() for _ in range(draw.randint(1, 6))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(30, vectors, 16)
    for query in vectors[:80]:
        full = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 9), i) for i, v in enumerate(vectors))
        want = [i for s, i in full if s < 0][:9]
        assert [i for i, _ in index.search(query, 9)] == want


def test_isotonic_fit_is_monotonic_and_keeps_the_mean():
    draw = np.random.default_rng(8)
    x = draw.random(200)
    y = (draw.random(200) < x).astype(float)
    knots, values = toxicity.isotonic(x, y, np.ones(200))
    fit = np.interp(x, knots, values)
    assert (np.diff(values) >= 0).all() and abs(fit.mean() - y.mean()) < 0.02


def test_network_gradients():
    draw = np.random.default_rng(9)
    texts = [bytes(draw.integers(1, 9, n).tolist()) for n in (0, 5, 70, 300)]
    labels, weights = np.array([0.0, 1, 0, 1]), np.array([1.0, 2, 1, 3])
    net = quality.Network(draw.normal(0, 0.7, (256, quality.EMBEDDED)), draw.normal(0, 0.7, (quality.WIDTH, quality.EMBEDDED, quality.FILTERS)),
                          draw.normal(0, 0.1, quality.FILTERS), draw.normal(0, 0.5, (2, quality.FILTERS)), np.zeros(1))
    slopes = quality.slopes_of(net, texts, labels, weights)

    def loss():
        p = net.probabilities(texts, net.tables())
        return -(weights / weights.sum() * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    for values, slope, tolerance in ((net.weights, slopes[3], 2e-3), (net.offset, slopes[4], 2e-3), (net.bias, slopes[2], 2e-2), (net.embedding, slopes[0], 2e-2)):
        at = tuple(int(n) // 2 for n in values.shape) if values is not net.embedding else (4, 2)
        before = values[at]
        values[at] = before + 1e-2
        high = loss()
        values[at] = before - 1e-2
        low = loss()
        values[at] = before
        assert abs((high - low) / 2e-2 - slope[at]) < tolerance


def test_network_sees_the_whole_text_and_learns():
    draw = random.Random(10)
    plain = lambda n: "".join(draw.choice("abcde ") for _ in range(n))
    texts, labels = [], []
    for i in range(240):
        text = plain(draw.randint(50, 900))
        texts.append((text + "Q!Q!Q!" if i % 2 else text).encode())  # what tells is at the very end
        labels.append(float(i % 2))
    net = quality.train(texts, np.array(labels), np.ones(240), epochs=12)
    p = net.probabilities(texts, net.tables())
    assert ((p > 0.5) == np.array(labels).astype(bool)).mean() > 0.97


def test_warc_records_are_checked():
    good = warc.record_of(7, "http://a/\r\nx y", "héllo".encode(), None, False)
    headers, block = warc.parse_record(good)
    page = warc.page_of(headers, block)
    assert (page["page_id"], page["payload_bytes"], page["record_type"], page["refers_to"]) == (7, 6, "response", None)
    assert headers["warc-target-uri"] == "http://a/%0D%0Ax%20y"
    again = warc.page_of(*warc.parse_record(warc.record_of(3, None, b"abc", 7, True)))
    assert (again["refers_to"], again["payload_bytes"], again["payload_digest"]) == (7, 3, warc.digest_of(b"abc"))
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Data"),
                good.replace(b"Content-Length: 6", b"Content-Length: 9"), good.replace("héllo".encode(), "hällo".encode())):
        with pytest.raises(ValueError):
            warc.page_of(*warc.parse_record(bad))


WORKER = """
import random, sys
import public_tokenizers
from scorewatch.llm import bpe
draw = random.Random(1)
codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
for _ in range(6):
    text = " ".join("".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(3, 14))) for _ in range(200_000)).encode()
    for ids in codec.encode([text[: len(text) // 2], text[len(text) // 2 :]]):
        codec.decode(ids)
print([int(line.split()[1]) // 1024 for line in open("/proc/self/status") if line.startswith("VmHWM")][0])
"""


def test_a_bpe_worker_stays_small():
    said = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, cwd=ROOT, check=True).stdout
    assert int(said.split()[-1]) < 330  # MB, 110 of them the imports, after a million unseen words
