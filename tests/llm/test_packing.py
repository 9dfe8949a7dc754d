from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from souk.llm import packing, registry

from .conftest import SF, make_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


@pytest.fixture(scope="session")
def shared(spark):
    return packing.vocabulary(spark, PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(docs, got, tokenizer, capacity=1024):
    """Every piece of every document, sequences gapless and within the capacity;
    gives the number of sequences."""
    expected = Counter()
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        n = -(-len(ids) // capacity)
        ends = [len(ids) - capacity * (n - 1 - p) for p in range(n)]
        for p, (start, end) in enumerate(zip([0, *ends], ends)):
            expected[i, p, start, end - start, crc(ids[start:end])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def brute_slack(lengths, capacity):
    """Minimum bin slack by trying every subset of small tables."""
    left, n = sorted(lengths, reverse=True), 0
    while left:
        head, rest = left[0], left[1:]
        best = max(
            (c for k in range(len(rest) + 1) for c in combinations(rest, k) if head + sum(c) <= capacity), key=sum
        )
        left = list((Counter(rest) - Counter(best)).elements())
        left.sort(reverse=True)
        n += 1
    return n


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 60)
        counts = sorted(Counter(lengths).items(), reverse=True)
        chosen = packing.fullest(counts, room)
        best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)
        assert sum(x * k for x, k in chosen) == best
        assert all(0 < k <= dict(counts)[x] for x, k in chosen)


def optimum(lengths, capacity):
    """Fewest bins, by trying every way (small tables)."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(loads)
            return
        for load in sorted(set(loads)):
            if load + lengths[i] <= capacity:
                j = loads.index(load)
                place(i + 1, loads[:j] + [load + lengths[i]] + loads[j + 1 :])
        place(i + 1, loads + [lengths[i]])

    place(0, [])
    return best[0]


def test_plan_against_brute_force():
    rng = random.Random(3)
    over = 0
    for _ in range(60):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        runs, n = packing.plan(dict(Counter(lengths)), 20)
        loads, seen = Counter(), Counter()
        for x, many in Counter(lengths).items():
            mine = sorted((r for r in runs if r.length == x), key=lambda r: r.first)
            for place in range(many):
                r = [r for r in mine if r.first <= place][-1]
                loads[r.sequence + (place - r.first) // r.k] += x
                seen[x] += 1
        assert seen == Counter(lengths) and set(loads) == set(range(n)) and max(loads.values()) <= 20
        best = optimum(lengths, 20)
        assert best <= n <= best + 1
        assert n <= brute_slack(lengths, 20) + 1
        over += n - best
    assert over <= 3


def test_many_equal_lengths_take_few_steps():
    runs, n = packing.plan({700: 10**9, 300: 10**9, 24: 3 * 10**9, 1024: 10**12}, 1024)
    assert len(runs) < 20 and n <= 10**12 + 10**9 + 10**9 // 16


def test_odd_rows(spark, odd, shared, tokenizer):
    docs = [(i, t) for i, t, _ in odd_rows()]
    check(docs, packing.pack(odd, shared).collect(), tokenizer)
    check(docs, packing.pack(odd, shared, capacity=16).collect(), tokenizer, 16)
    check(docs, packing.pack(odd, shared, capacity=1).collect(), tokenizer, 1)


def test_hot_text_and_rows_without_an_id(spark, shared, tokenizer):
    docs = [(None, "one text that many rows share " * 30)] * 90 + [(i, "x " * i) for i in range(60)]
    got = packing.pack(make_docs(spark, [(i, t, "x") for i, t in docs]).repartition(5), shared).collect()
    total = sum(r["length"] for r in got)
    assert check(docs, got, tokenizer) <= 1.2 * total / 1024 + 1


def test_empty_table(spark, no_docs, shared):
    got = packing.pack(no_docs, shared)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.collect() == []


def test_real_sequences(spark, odd, shared, tokenizer):
    packed = packing.pack(odd, shared, capacity=64, with_ids=True)
    got = packed.collect()
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(whole) == len({r["sequence_id"] for r in got})
    for r in got:
        ids = whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert ids == r["ids"] and crc(ids) == r["ids_crc32"]
    check([(i, t) for i, t, _ in odd_rows()], got, tokenizer, 64)


def test_ids_equal_the_library_s(spark, shared, tokenizer):
    rng = random.Random(4)
    alphabets = ["ab", " \n\ta.", "0123 ", "éèüß ", "日本語 ", "😀👍é ", "'sSretdvl ", "  \u0085 x", "the and ing "]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(200))) for a in alphabets for _ in range(40)]
    texts += ["<|endoftext|>a <|endoftext|> b", "word " * 3000, "x" * 5000, " " * 5000 + "y", "a  b   c \n d " * 500]
    encoder = packing.Vocabulary(shared.value.ranks_file, shared.value.pattern).built()[0]
    for text in texts:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for span in (1, 17, 1000, packing.SPAN):
            assert packing.ids_of(text, encoder, span) == ids


def test_query(spark, documents, tokenizer):
    got = registry.QUERIES["op11_packing"](spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    n = check(docs, got, tokenizer)
    total = sum(r["length"] for r in got)
    assert n <= 1.02 * -(-total // 1024) + 1
