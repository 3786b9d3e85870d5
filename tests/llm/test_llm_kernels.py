"""The operators' kernels without Spark, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from decidra.llm import ann, exact_dedup, license_scan, ngram_join, packing, rans, toxicity
from decidra.llm._shingles import shingle_sets
from decidra.llm._tokens import ColumnEncoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "!", "\xa0", "́", "Σ", "İ", "日本", "\x1c", "\r", "<|endoftext|>", "<|", "​", "don't", " \n", "x"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "x" * 5000, "word " * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_are_the_librarys(name):
    coder = ColumnEncoder(public_tokenizers.path(name))
    assert coder.kind != "other"
    rng = random.Random(3)
    letters = "".join(map(chr, range(1, 0x260)))
    narrow = ["".join(rng.choice("ab É\n.,'s0 1\t'trevmld  LSTRED") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts = [*odd_texts(3000), *narrow, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(3000)), None]
    want = [np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7], dtype="<u4").tobytes() for t in texts]
    for _ in range(2):  # the second time from the table
        for text, ids, got in zip(texts, want, coder.texts(pa.array(texts), 7), strict=True):
            assert ids == got, repr(text)


def block_words(n):
    """A word of n letters in which each block is followed by its complement, and the word with the two letters exchanged."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_alternate_keep_their_own_ids(name, n):
    """Polynomials modulo a power of two give both words one value."""
    one, two = block_words(n)
    coder, texts = ColumnEncoder(public_tokenizers.path(name)), [one, two, f"x {one} y {two}", one]
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [*coder.texts(pa.array(texts))] == want == [*coder.texts(pa.array(texts))]
    a, b, both = shingle_sets(pa.array([one, two, f"{two} {one}"]), 1)
    assert a[0] != b[0] and {*both} == {*a, *b}


def test_pieces_of_one_hash_are_told_by_their_bytes(monkeypatch):
    from decidra.llm import _tokens

    monkeypatch.setattr(_tokens, "mix64", lambda h: h & np.uint64(3))  # four hashes for all pieces
    coder = ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three, four", "five one six!", "", "seven " * 9]
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [*coder.texts(pa.array(texts))] == want == [*coder.texts(pa.array(texts))]


def test_a_full_table_starts_afresh(monkeypatch):
    from decidra.llm import _tokens

    monkeypatch.setattr(_tokens, "MOST_PIECES", 50)
    coder = ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} is one of several words, {i}" for i in range(40)] * 3
    for _ in range(2):
        for text in texts:
            assert list(coder.texts(pa.array([text, "", None]))) == [np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), b"", b""]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles(k):
    texts = [*odd_texts(400), None]
    want, got = [shingles(t, k) for t in texts], [set(map(int, s)) for s in shingle_sets(pa.array(texts), k)]
    assert [len(s) for s in want] == [len(s) for s in got]
    for i in range(0, len(texts), 3):
        for j in range(i):
            assert len(want[i] & want[j]) == len(got[i] & got[j])


@pytest.mark.parametrize("n", [0, 1, 5, 700, 300_001])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000).astype(np.uint32)
    table = rans.table_of(rans.scaled(np.bincount(ids, minlength=49_408)))
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(n, block, table) == ids).all()
    if n > 200_000:  # a segment can be decoded alone, and damage shows
        span = rans.SEGMENT_STEPS * block["lanes"]
        assert (rans.decode_segment(1, n, block, table) == ids[span : 2 * span]).all()
        words = bytearray(block["words"])
        words[len(words) // 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode_block(n, block | {"words": bytes(words)}, table)


def test_rans_table():
    counts = np.array([10**9] + [1] * 50_000 + [0])
    freq = rans.scaled(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[counts > 0] > 0).all() and freq[-1] == 0


def test_fuse_filter():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 20_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.build_fuse(keys)
        assert exact_dedup.probe_fuse(keys, *made).all()
        others = rng.integers(0, 2**63, 20_000).astype(np.uint64)
        assert exact_dedup.probe_fuse(others, *made).mean() < 0.02


def test_best_fit():
    packer, rng, bins = packing.BestFit(100, 4), random.Random(5), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        number, offset = packer.place(n)
        assert bins.get(number, 0) == offset
        bins[number] = offset + n
        assert bins[number] <= 100 and packer.n_open <= 4
    with pytest.raises(ValueError):
        packer.place(101)


def test_best_fit_against_a_list():
    """Every item goes to the tightest open bin that takes it; the fullest closes when one too many is open."""
    rng = random.Random(9)
    packer, free = packing.BestFit(50, 5), {}  # bin -> free space of the open ones
    for _ in range(3000):
        n = rng.choice([1, 2, 49, 50, rng.randint(1, 50)])
        fits = [f for f in free.values() if f >= n]
        number, offset = packer.place(n)
        if fits:
            assert free[number] == min(fits) and offset == 50 - free[number]
        else:
            assert number not in free and offset == 0
            if len(free) == 5 and n < 50:
                closed = min(free.values())
                gone = next(b for b, f in free.items() if f == closed and b not in {x for xs in packer.bins.values() for x in xs})
                del free[gone]
            free[number] = 50
        free[number] -= n
        if not free[number]:
            del free[number]
        assert sorted(free.values()) == sorted(f for f, held in packer.bins.items() for _ in held) and packer.n_open == len(free)


def test_licence_phrases():
    text = "CC BY, cc-by; ALL rights reserved. ÄLL Rights é1 cc by cc by General  Public\nLicense"
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    mine = license_scan.words_of(text.encode())
    assert [w.encode() for w in words] == mine
    for phrase in license_scan.BASE:
        parts = phrase.split()
        assert license_scan.phrase_starts(b" " + b" ".join(mine) + b" ", phrase.encode()) == [i for i in range(len(words)) if words[i : i + len(parts)] == parts]


def test_licence_index():
    index = license_scan.Index(license_scan.TEMPLATES, {})
    find = lambda t: index.match(license_scan.words_of(t))
    assert set(find(b"x y. Licensed under the Apache License, Version 2.0. z")) == {"apache-2.0"}
    assert set(find(b"Released under the MIT License.")) == {"mit"}
    assert not find(b"the version of the licence that was released") and not find(b"")


NOTICES = {
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0",
    "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "agpl-3.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl-2.0",
    "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.": "cc0-1.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    "CC BY 4.0": "cc-by-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
}


def test_key_phrases_are_in_their_templates():
    for t in license_scan.TEMPLATES:
        assert all(f" {k} " in f" {t.words} " for k in t.keys), t


def test_common_licences_are_found_too():
    """A file of eight licences, where every file of the corpus has their words."""
    wanted = {"mit", "bsd", "isc", "zlib", "unlicense", "apache-2.0", "gpl-3.0", "mpl-2.0"}
    notices = [next(t for t in license_scan.TEMPLATES if t.label == label and len(t.words.split()) > 9) for label in sorted(wanted)]
    words = license_scan.words_of(" x1 ".join(t.words for t in notices).encode())
    for idf in (0.0, 0.01, 5.0):
        index = license_scan.Index(license_scan.TEMPLATES, dict.fromkeys(words, idf))
        assert set(index.match(words)) == wanted
        assert set(license_scan.Index(license_scan.TEMPLATES, {w: 9.0 * (w in (b"0", b"1", b"2", b"2004")) for w in words}).match(words)) == wanted


def test_licence_notices_against_every_place():
    """Notices among prose: what the index finds is what trying every template at every word finds."""
    rng = random.Random(6)
    prose = ["the", "of", "this", "software", "license", "version", "permission", "notice", "x1", "house", "under", "free", "2", "0", "any", "copyright"]
    idf = collections.Counter({w.encode(): 1.0 for w in prose})
    index = license_scan.Index(license_scan.TEMPLATES, {w: idf.get(w, 4.0) for t in license_scan.TEMPLATES for w in t.words.encode().split()})
    for n in range(60):
        notice, label = rng.choice(list(NOTICES.items()))
        body = [rng.choice(prose) for _ in range(rng.randint(0, 60))]
        if n % 3:
            body.insert(rng.randint(0, len(body)), notice)
        if n % 5 == 0:
            body.insert(rng.randint(0, len(body)), rng.choice(list(NOTICES)))
        words = license_scan.words_of(" ".join(body).encode())
        for gone in rng.sample(range(len(words)), min(len(words) // 20, 3)) if n % 4 == 0 else ():
            words[gone : gone + 1] = rng.choice([[], [b"x1", words[gone]]])
        every: dict = {}
        for number, (name, wanted, _) in enumerate(index.templates):
            for start in range(-len(wanted), len(words)):
                if (cover := license_scan.place_of(number, start, index, words)) >= license_scan.LEAST_COVER:
                    every[name] = max(every.get(name, 0.0), cover)
        assert index.match(words) == every
        assert not n % 3 or n % 4 == 0 or label in every


def test_folding_and_exceptions():
    assert toxicity.fold("ЅTUРID 1d10t") == "stupid idiot"  # Cyrillic letters and digits
    model = toxicity.Model((("stupid", 5.0), ("trash", 5.0)), ("trash can",), 0.1, -3.0, 4.0)
    scorer = toxicity.Scorer(model)
    assert scorer.matches("what a st​up1d thing")[1] == 1
    assert scorer.matches("put it in the trash can")[1] == 0 and scorer.matches("trash. it")[1] == 1
    assert scorer.matches("")[:2] == (0.0, 0) and 0 <= scorer.score(0.0, 0) < 0.3 < scorer.score(5.0, 10) <= 1


def test_matches_against_a_scan():
    """The automaton and the exceptions against looking at every word."""
    rng = random.Random(10)
    entries, exceptions = (("scum", 2.0), ("scumbag", 1.5), ("idiot", 3.0), ("vile", 0.5)), ("pond scum", "idiot proof kit", "vile weather")
    scorer = toxicity.Scorer(toxicity.Model(entries, exceptions, 1.0, 0.0, 1.0))
    pool = ["scum", "ѕсum,", "scumbags", "1d1ot", "IDIOTIC", "pond", "proof", "kit", "weather", "vile", "a", "víle", "scu", "xscum", "-"]
    for _ in range(500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        words = toxicity.fold(text).split(" ")
        line = " " + toxicity.fold(text)
        phrases = [" " + x for x in exceptions]
        total = n = 0
        at = -1
        for word in words:
            at = line.index(" " + word, at + 1) if word else at + 1
            inside = any(line.startswith(p, b) and b <= at < b + len(p) for p in phrases for b in range(max(0, at - 20), at + 1))
            for entry, weight in entries:
                if word.startswith(entry) and not inside:
                    total, n = total + weight, n + 1
        got = scorer.matches(text)
        assert got[0] == pytest.approx(total) and got[1] == n, text


def test_exceptions_are_learned():
    rng = random.Random(12)
    filler = lambda: [f"w{rng.randint(0, 500)}" for _ in range(30)]
    toxic = [(" ".join([*filler(), "scumbag", *filler()]), 1) for _ in range(200)]
    clean = [(" ".join([*filler(), "pond", "scumbag", *filler()]) if i < 15 else " ".join(filler()), 0) for i in range(800)]
    model = toxicity.fit(toxic + clean)
    assert "pond scumbag" in model.exceptions and any("scumbag".startswith(e) for e, _ in model.entries)
    scorer = toxicity.Scorer(model)
    assert scorer.matches("some pond scumbag here")[1] == 0 and scorer.matches("some scumbag here")[1] == 1


def test_toxicity_fit_held_out():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeou") for _ in range(rng.randint(2, 4)))

    def doc(bad):
        words = [word() for _ in range(rng.randint(5, 120))]
        return " ".join(words[:3] + [rng.choice(["scumbag", "m0ron", "worthless"])] * bad + words[3:]), int(bad)

    rows = [doc(i % 8 == 0) for i in range(1200)]
    scorer = toxicity.Scorer(toxicity.fit(rows[:800]))
    right = [(scorer.score(*scorer.matches(t)[::2]) >= 0.3) == bool(y) for t, y in rows[800:]]
    assert sum(right) / len(right) > 0.98
    assert toxicity.fit([]).entries == () and toxicity.fit([("a b", 0)]).entries == ()


def test_additive_codes():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit_codebooks(x, books=6, words=32)
    decoded = books[np.arange(6), ann.encode(x, books, 4)].sum(1)
    greedy = books[np.arange(6), ann.encode(x, books, 1)].sum(1)
    assert ((x - decoded) ** 2).sum() <= ((x - greedy) ** 2).sum() < (x**2).sum() / 3


def test_thresholds():
    for num in (80, 85):
        t = ngram_join.Threshold(num, 100)
        for n in range(1, 400):
            assert t.deletions(n) == n - -(-num * n // 100)
            least, most = max(1, -(-num * n // 100)), n * 100 // num
            assert t.shared(n) == max(1, min(t.prefix(m) - t.deletions(m) for m in range(least, most + 1)))
            assert all(0 <= t.band(n) - t.band(m) <= 1 for m in range(least, n + 1))


def test_signatures_meet():
    """Sets that link share a signature, whatever the classes of their tokens."""
    rng, t = np.random.default_rng(8), ngram_join.Threshold(80, 100)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        kept, new = rng.random(n) < 0.9, rng.integers(1, 2**63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)
        x, y = np.unique(base), np.unique(np.concatenate([base[kept], new]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        kind = lambda s: (s >> np.uint64(9)) % np.uint64(3)  # noqa: E731  0: only its own holder has it, unless it is shared
        shared = set(np.intersect1d(x, y).tolist())
        split = lambda s: ([v for v in s.tolist() if v in shared and kind(np.uint64(v)) == 1], [v for v in s.tolist() if (v in shared and kind(np.uint64(v)) != 1)])
        with np.errstate(over="ignore"):
            sigs = [set(np.concatenate(ngram_join.prefix_signatures(len(s), *(np.array(p, np.uint64) for p in split(s)), t) or [np.zeros(0, np.uint64)]).tolist()) for s in (x, y)]
        assert sigs[0] & sigs[1]


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 256], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\0\x01\0\0")


def test_cutoffs_leave_a_shortlist_and_little_more():
    """Of 50,000 classes a sample's cutoff lets the whole shortlist through, and less than four times as many, for each of 300 queries."""
    rng = np.random.default_rng(8)
    classes, shortlist = 50_000, 716
    sampled = int(np.ceil(ann.SAMPLED * classes / shortlist))
    rank = ann.sample_rank(shortlist, classes, sampled)
    emitted = []
    for _ in range(300):
        scores = rng.normal(size=classes)
        cutoff = -np.partition(-rng.choice(scores, sampled, replace=False), rank - 1)[rank - 1]
        emitted.append(int((scores >= cutoff).sum()))
    assert min(emitted) >= shortlist and np.mean(emitted) < 3 * shortlist and max(emitted) < 5 * shortlist
    assert ann.sample_rank(700, 500, 500) == 700
