"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, decontam, jaccard, langid, licenses, media, packing, quality, registry, substrings, tokenfile, toxicity
from tessera.llm.bpe import Encoder, vocabulary
from tessera.llm.common import ALNUM, LOWER

SCHEMA = "doc_id long, text string"


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    base = words(300, 1)
    passage = words(70, 2)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:150] + ["x"] + base[151:])), (4, None), (5, ""), (6, "  \n "), (7, "One two"), (8, "one TWO"), (9, "é"), (10, " ".join(words(20_000, 3, 50)))]
    rows += [(11 + i, " ".join(words(60, 10 + i) + passage + words(50, 50 + i))) for i in range(8)]
    rows += [(30 + i, " ".join(base[: 290 - 7 * i] + words(5 + 8 * i, 80 + i))) for i in range(8)]
    rows += [(40, "the " * 200), (41, "the " * 120), (42, " ".join(base[100:160])), (43, " ".join(base[100:150])), (44, " ".join(base[100:149]))]
    rows += [(None, " ".join(base)), (7, "One two")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_substrings_against_brute_force(corpus):
    rows = plain(corpus)
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), doc)
    expected = Counter()
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = bytearray(len(w))
        for k in range(len(w) - 49):
            if doc is not None and first[tuple(w[k : k + 50])] < doc:
                gone[k : k + 50] = b"\1" * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[(doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, substrings.digest(substrings.with_spans(corpus)).collect())) == expected
    assert sum(n for _, _, n, _ in expected) > 500


def brute_components(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        if doc is not None:
            sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "den", "least"), [(4, 85, 100, 4), (5, 80, 100, 4), (2, 20, 100, 4), (1, 1, 1, 3)])
def test_jaccard_against_brute_force(corpus, k, num, den, least):
    got = jaccard.linked(corpus, k, num, den).collect()
    expected = brute_components(plain(corpus), k, num, den)
    assert {r["doc"]: (r["n"], r["component"]) for r in got if r["doc"] is not None} == expected
    assert [r["component"] for r in got if r["doc"] is None] == [None] and len(got) == corpus.count()
    assert len({c for _, c in expected.values()}) <= len(expected) - least


def test_jaccard_hot_near_copies(spark):
    base = words(200, 5, 5000)
    rng = random.Random(9)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc"]: (r["n"], r["component"]) for r in jaccard.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def chain(rng, n):
    """Copies of copies: families whose ends are far apart, so that few link to the cleanest copy."""
    rows, family = [], [words(rng.randrange(20, 90), rng.randrange(10**6), 5000) for _ in range(4)]
    for i in range(n):
        f = rng.randrange(len(family))
        w = list(family[f])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3)
        if rng.random() < 0.6 and len(w) > 5:
            family[f] = w
        rows.append((rng.randrange(10**6), " ".join(w)))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_chains_of_copies(spark, seed):
    rows = chain(random.Random(seed), 150)
    got = {r["doc"]: (r["n"], r["component"]) for r in jaccard.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_work_in_a_group_grows_with_its_size(spark):
    base, rng = words(200, 5, 5000), random.Random(9)

    def met(n):
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            w = list(base)
            for at in rng.sample(range(200), rng.randrange(9)):
                w[at] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        sets = jaccard.sets(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).dropDuplicates(["h1"]).withColumn("vertex", F.col("doc"))
        entries = jaccard.index_lists(sets, 85, 100)
        first = jaccard.with_pivots(entries).cache()
        comps = jaccard.components(first.toDF("u", "v"))
        return first.count() + jaccard.between(entries, comps)[0].count()

    few, many = met(100), met(800)
    assert many < 12 * few


def test_jaccard_refuses_a_senseless_threshold(spark):
    for num, den in ((0, 100), (101, 100)):
        with pytest.raises(ValueError, match="threshold"):
            jaccard.linked(spark.createDataFrame([(1, "a")], SCHEMA), num=num, den=den)


def test_jaccard_links_every_text_of_an_id(spark):
    a, b, c = (" ".join(words(80, i, 9000)) for i in (1, 2, 3))
    rows = [(5, a), (5, b), (6, b + " x"), (4, a + " y"), (7, c), (7, ""), (3, c), (8, ""), (5, b)]
    got = sorted((r["doc"], r["component"]) for r in jaccard.linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(3, 3), (4, 4), (5, 4), (5, 4), (5, 4), (6, 4), (7, 3), (7, 3), (8, 8)]


def test_decontamination_against_brute_force(spark, corpus):
    base = words(300, 1)
    items = [(1, " ".join(base[20:45]).upper()), (2, " ".join(base[30:42])), (3, "one, two"), (4, None), (5, "!!"), (6, " ".join(base[20:45])), (10, "É")]
    got = decontam.scan(corpus.select("doc_id", "text"), items, decontam.digest, decontam.DIGEST, max_symbols=500, max_docs=4)
    bench = decontam.Benchmark(spark.createDataFrame(items, "item_id long, text string"), max_bytes=200)
    assert bench.n > 2
    grouped = decontam.search(corpus, bench, decontam.digest, decontam.DIGEST, max_symbols=500, max_docs=4)
    phrases = defaultdict(set)
    for i, t in items:
        w = (t or "").encode().translate(ALNUM).split()
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[k : k + 10])].add(i)
    expected = Counter()
    for doc, text in plain(corpus):
        w, hit, found = (text or "").encode().translate(ALNUM).split(), set(), set()
        for p, ids in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        expected[(doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(map(tuple, got.collect())) == expected
    assert Counter(map(tuple, grouped.collect())) == expected


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    none = decontam.Benchmark(spark.createDataFrame([], "item_id long, text string"))
    assert decontam.clean(docs, none).first()["text"] == "a b"
    assert decontam.search(docs, none, decontam.digest, decontam.DIGEST).first()["contaminated"] is False
    assert decontam.cut(b"Keep this, not THAT one. End", [[2, 4]]) == b"Keep this,  one. End"


def test_decontamination_keeps_other_columns(spark):
    names = ["doc_id", "text", "_text", "_changed", "rest", "some", "a.b"]
    docs = spark.createDataFrame([(1, "x One, TWO three y", 5, 6, 7, 8, 9), (2, None, 5, 6, 7, 8, 9), (3, "", 5, 6, 7, 8, 9)], "doc_id long, text string, _text int, _changed int, rest int, some int, `a.b` int")
    for size in (1 << 20, 80):
        bench = decontam.Benchmark(spark.createDataFrame([(1, "one two three"), (2, "zz")], "item_id long, text string"), max_bytes=size)
        got = decontam.clean(docs, bench, changed="edited")
        assert got.columns == [*names, "edited"]
        assert sorted(map(tuple, got.collect())) == [(1, "x  y", 5, 6, 7, 8, 9, True), (2, None, 5, 6, 7, 8, 9, False), (3, "", 5, 6, 7, 8, 9, False)]
        assert decontam.clean(docs, bench).columns == ["doc_id", "text", "_text", "rest", "some", "a.b", "_changed"]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 5, 3000)
    index = decontam.FMIndex(text, 4)
    phrases = [np.array(p) for p in ([1], [1, 2], [3, 3, 1], [4, 1, 2, 2], [2] * 12)]
    backwards = np.zeros((len(phrases), 12), np.int32)
    for row, p in zip(backwards, phrases, strict=True):
        row[: len(p)] = p[::-1]
    lo, hi = index.search(backwards, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        places = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_encoder_is_exact():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext", "", "a", "  a b", "a\n\nb", " a", "a ", "x \n y", "é  ü", "don't  stop it's", "\n", "a\tb \tc", "<|endoftext|> x", "a\x00b", "日本 語\n語", "Was.\nThen, 12% of $$$ won!!", "naïve ²x Ⅷ y_z", "a b  c", None]
    for room in (1, 1000):
        e = Encoder(vocabulary(), room=room)
        for _ in range(2):
            assert [x.tolist() for x in e.encode(texts)] == [tok.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(corpus, tmp_path, planes):
    path = str(tmp_path / planes)
    tokenfile.write(corpus, path, shard_ids=3000, block=512, planes=planes)
    tok = Tokenizer.from_file(vocabulary())
    got = tokenfile.read(corpus.sparkSession, path).orderBy("start").collect()
    rows = sorted(plain(corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (doc, at, len(ids), ids.tobytes())
        at += len(ids)


def test_one_block_reads_alone():
    ids = np.arange(1000, dtype="<u2")
    for planes in ("byte", "bit"):
        ends, blob = tokenfile.pack_shard(ids, 128, planes)
        assert tokenfile.read_block(7, 1000, 128, 2, planes, ends, blob).tolist() == list(range(896, 1000))


def test_packing_covers_every_token_once(corpus):
    tok = Tokenizer.from_file(vocabulary())
    pieces = packing.pack(corpus, size=256).collect()
    expected, got = Counter(), Counter()
    for doc, text in plain(corpus):
        expected[(doc, len(tok.encode(text or "", add_special_tokens=False).ids) + 1)] += 1
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        if p["start"] + p["length"] == p["doc_tokens"]:
            got[(p["doc_id"], p["doc_tokens"])] += 1
    assert got == expected and sum(p["length"] for p in pieces) == sum(n * c for (_, n), c in expected.items())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0


def test_packed_ids_are_those_of_the_pieces(corpus):
    tok = Tokenizer.from_file(vocabulary())
    ids = defaultdict(list)
    for doc, text in plain(corpus):
        ids[doc].append([*tok.encode(text or "", add_special_tokens=False).ids, 1])
    for p in packing.pack(corpus, size=256).collect():
        crcs = {zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]}
        assert p["ids_crc32"] in crcs


def test_packing_of_conversations_bounds_their_loss(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    examples = packing.answers(turns).withColumn("loss_from", F.lit("another column")).cache()
    given = {r["doc_id"]: r for r in examples.collect()}
    assert len(given) == turns.where("role = 'assistant'").count()
    tok = Tokenizer.from_file(vocabulary())
    size = lambda x: len(tok.encode(x or "", add_special_tokens=False).ids)
    total, covered = defaultdict(Counter), Counter()
    for p in packing.pack(examples, size=512, max_segments=16, max_loss=200, prompt="prompt").collect():
        free = size(given[p["doc_id"]]["prompt"])
        assert p["doc_tokens"] == free + size(given[p["doc_id"]]["text"]) + 1
        assert p["loss_tokens"] == max(0, p["start"] + p["length"] - max(p["start"], free))
        total[p["sequence_id"]].update(tokens=p["length"], segments=1, loss=p["loss_tokens"])
        covered[p["doc_id"]] += p["length"]
    assert all(t["tokens"] <= 512 and t["segments"] <= 16 and t["loss"] <= 200 for t in total.values())
    assert max(t["loss"] for t in total.values()) > 150 and all(n == size(given[d]["prompt"]) + size(given[d]["text"]) + 1 for d, n in covered.items())


def test_packing_limits():
    rng = random.Random(4)
    ids = [np.zeros(rng.randrange(1, 150), np.uint16) for _ in range(300)]
    free = [rng.randrange(0, 100) for _ in ids]
    p = packing.Packer(size=100, max_segments=4, max_loss=60, pool=32)
    rows = p.add(list(range(300)), ids, free) + p.finish()
    total = defaultdict(lambda: [0, 0, 0])
    covered = defaultdict(list)
    for doc, start, length, _, n, seq, _, loss in rows:
        assert n == len(ids[doc]) and loss == max(0, start + length - max(start, free[doc]))
        covered[doc].append((start, length))
        for i, x in enumerate((length, 1, loss)):
            total[seq][i] += x
    assert all(t <= 100 and s <= 4 and loss <= 60 for t, s, loss in total.values())
    for doc, x in enumerate(ids):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == len(x)


def test_media_round_trip(corpus):
    got = media.fingerprint(media.encode(corpus)).collect()
    by = defaultdict(set)
    expected = Counter()
    for doc, text in plain(corpus):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        expected[(doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == expected
    for r in got:
        assert r["media_bytes"] > r["payload_bytes"] and len(r["times"]) == len(r["codes"]) and r["times"] == sorted(r["times"])
        by[r["payload_sha256"]].add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in by.values())


def test_fingerprint_against_loops(spark):
    text = " ".join(words(150, 8)) + " é"
    row = media.fingerprint(media.encode(spark.createDataFrame([(1, text)], SCHEMA))).first()
    payload = media.pad(text.encode())
    level = []
    for at in range(0, len(payload) - 192 + 1, 96):
        frame = [(b - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * i / 191)) for i, b in enumerate(payload[at : at + 192])]
        level.append([round(8 * np.log2(1 + abs(sum(v * np.exp(-2j * np.pi * k * i / 192) for i, v in enumerate(frame))))) for k in range(97)])
    peaks = []
    for t, x in enumerate(level):
        top = [k for k in range(1, 96) if x[k] > x[k - 1] and x[k] >= x[k + 1]]
        peaks += [(t, k) for k in sorted(sorted(top, key=lambda k: (-x[k], k))[:3])]
    expected = [(t, a << 20 | b << 8 | u - t) for t, a in peaks for u, b in peaks if t < u <= t + 4]
    assert list(zip(row["times"], row["codes"], strict=True)) == expected
    assert row["feature"].startswith(f"{len(level)}f{len(expected)}p")


def test_media_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a", "mine", 5, "x", 9)], "doc_id long, text string, feature string, media int, n_bytes string, other int")
    got = media.fingerprint(media.encode(df))
    assert len(set(got.columns)) == len(got.columns) and got.select("other", "n_bytes").first() == (9, 1) and got.first()["feature"] != "mine"


def test_licenses_inherit(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "no"), ("a/b/c/y.py", "hi\nLicensed under the Apache License, Version 2.0."), ("a/b/COPYING.txt", "All rights reserved."), ("a/b/c/z.py", ""), ("z.py", None), (None, "x"), ("a/b/x.py", "no")]
    got = Counter((r["path"], r["license"], r["origin"], r["from_dir"]) for r in licenses.inherit(licenses.detect(spark.createDataFrame(rows, "path string, text string"))).collect())
    assert got == Counter({("a/LICENSE", "MIT", "own", None): 1, ("a/b/x.py", "Proprietary", "inherited", "a/b"): 2, ("a/b/c/y.py", "Apache-2.0", "own", None): 1, ("a/b/COPYING.txt", "Proprietary", "own", None): 1, ("a/b/c/z.py", "Proprietary", "inherited", "a/b"): 1, ("z.py", None, "none", None): 1, (None, None, "none", None): 1})


MIT_TEXT = """Copyright (c) 2020 Some One. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public
# License as published by the Free Software Foundation, either version {} of
# the License, or (at your option) any later version."""


def test_licenses_in_wrapped_headers_texts_and_long_lines(spark):
    prose = "word " * 200
    rows = [("m/LICENSE", MIT_TEXT, "MIT"), ("m/x.py", "no", "MIT"), ("g.py", GPL_HEADER.format("", 3), "GPL-3.0"), ("l.py", GPL_HEADER.format("Lesser ", 2.1), "LGPL-2.1")]
    rows += [("l3.py", GPL_HEADER.format("Lesser ", 3), None), ("s.py", "x\n// SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"), ("n.py", f"{prose}released under the MIT License {prose}", "MIT"), ("w.py", f"{prose}licensed under the Apache\n License, Version 2.0 {prose}", "Apache-2.0"), ("o.py", f"{prose} granted, reserved {prose}", None)]
    got = {r["path"]: r["license"] for r in licenses.inherit(licenses.detect(spark.createDataFrame([r[:2] for r in rows], "path string, text string"))).collect()}
    assert got == {path: name for path, _, name in rows}


def test_license_titles_and_sisters(spark):
    rows = [("t", "GNU GENERAL PUBLIC LICENSE\nVersion 3", "GPL-3.0"), ("u", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1", "LGPL-2.1"), ("v", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3", None), ("w", "GNU GENERAL PUBLIC LICENSE, version 2", None), ("x", "Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"), ("y", "SPDX-License-Identifier: MIT", "MIT"), ("z", "Licensed under CC BY-NC-SA 4.0.", None)]
    got = {r["path"]: r["own_license"] for r in licenses.detect(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {path: name for path, _, name in rows}


BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."


def test_license_tags_and_the_two_bsd_texts(spark):
    tag = "# SPDX-License-Identifier: "
    rows = [("d/LICENSE", "Released under the MIT License.", "MIT"), ("d/a", f"{tag}GPL-2.0-only\n", "GPL-2.0-only"), ("d/b", f"{tag}(GPL-2.0 OR mit)\nx", "GPL-2.0 OR MIT"), ("d/c", f"/* {tag}Apache-2.0 WITH LLVM-exception */", "Apache-2.0 WITH LLVM-exception"), ("d/d", f"{tag}(MIT or ISC) and GPL-3.0+", "(MIT OR ISC) AND GPL-3.0"), ("d/e", f"{tag}(MIT\n", "MIT"), ("d/f", f"{tag}\n", "MIT"), ("d/g", None, "MIT")]
    rows += [("b2", BSD_2 + AS_IS, "BSD-2-Clause"), ("b3", BSD_2 + BSD_3 + AS_IS, "BSD-3-Clause")]
    got = {r["path"]: r["license"] for r in licenses.inherit(licenses.detect(spark.createDataFrame([r[:2] for r in rows], "path string, text string"))).collect()}
    assert got == {path: name for path, _, name in rows}


def test_long_license_lines_take_linear_work(spark):
    line = " ".join(words(20_000, 6)) + " licensed under the Apache License, Version 2.0"
    df = licenses.detect(spark.createDataFrame([("a", line)] , "path string, text string"))
    df.collect()
    began = time.time()
    assert df.first()["own_license"] == "Apache-2.0"
    assert time.time() - began < 5


def test_licenses_of_ties_and_clashes(spark):
    got = licenses.detect(spark.createDataFrame([(1, "a one license", "mine", 7)], "k int, text string, own_license string, _line int"), templates=[("B", "a one license"), ("A", "a one license")])
    assert got.columns == ["k", "_line", "text", "own_license", "own_score"] and got.first()["own_license"] == "B"
    files = spark.createDataFrame([("d/LICENSE", "ISC", 0.9), ("d/COPYING", "BSD", 0.9), ("d/x", None, None)], "path string, own_license string, own_score double").withColumn("license", F.lit("mine"))
    assert {r["path"]: r["license"] for r in licenses.inherit(files).collect()}["d/x"] == "BSD"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir) == ""


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "the dogs", 5), (2, "und Hunde", 5), (3, None, 5), (4, "12 !", 5), (5, "", 5), (None, "cat", 5)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(probe, model).collect()}
    assert got[1][0] == got[None][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0)
    numbers = spark.createDataFrame([(1, "² ½ Ⅷ ٣ _"), (2, "²a")], SCHEMA)
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in langid.predict(numbers, model).collect()} == {1: True, 2: False}
    empty = langid.train(probe.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in langid.predict(probe, empty).collect()} == {"und"}


def test_rare_language_is_learned(spark):
    rows = [(" ".join(words(20, i, 60)), "en") for i in range(3000)] + [("zu ba zu ba", "xx")] * 2
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_docs=30, max_entries=40)
    assert model.langs == ["en", "xx"] and {"zu", "ba"} <= set(model.words)


def test_languages_against_dictionaries(spark):
    rng = random.Random(12)
    stem = {"en": "the of and ing tion word ness", "de": "der und ung keit heit wort sch", "fr": "le et ment eau eux mot aux"}
    make = lambda lang, n: " ".join("".join(rng.choice(stem[lang].split()) for _ in range(rng.randrange(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 12), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    probe = [(i, make(lang, 5) + rng.choice(["", " Qxz", " ungtion"])) for i, lang in enumerate(["en", "de", "fr"] * 10)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(probe, SCHEMA), langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    langs, counts = sorted(stem), [defaultdict(Counter) for _ in range(5)]
    for _, text, lang in rows:
        for w in text.lower().split():
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    counts[n][f"<{w}>"[i : i + n]][lang] += 1
    tables = []
    for table in counts:
        table = {k: c for k, c in table.items() if sum(c.values()) >= 2}
        total = {x: max(1, sum(c[x] for c in table.values())) for x in langs}
        tables.append({k: np.array([np.log((c[x] + 0.1) / (total[x] + 0.1 * len(table))) for x in langs]) for k, c in table.items()})
    for doc, text in probe:
        vectors = []
        for w in text.lower().split():
            v = tables[0].get(w)
            for n in range(4, 0, -1):
                known = [tables[n][g] for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in tables[n]]
                if v is None and known:
                    v = np.mean(known, axis=0)
            vectors.append(np.zeros(3) if v is None else v)
        mean = np.mean(vectors, axis=0)
        p = np.exp((mean - mean.max()) * min(len(vectors), 20))
        assert got[doc]["lang_pred"] == langs[int(np.argmax(mean))] and got[doc]["score"] == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_language_model_is_bounded_by_cells(spark):
    rows = [(f"w{i} x{i} w{i} x{i}", f"l{i % 20}") for i in range(400)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_cells=400)
    assert len(model.langs) <= 20 and all(len(t) <= 20 for t in [model.word_scores, *model.gram_scores])


def test_quality_against_one_solve(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng.randrange(1, 60), i, 30 if i % 2 else 900)) + ("!!!$$$ " * (i % 5) if i % 2 else ".")) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i % 7], "doc_id long, quality int")
    model = quality.train(docs, labels, n_features=32)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    known = [(i, text) for i, text in rows if i % 7]
    x, y = quality.vectors([t.encode() for _, t in known]), np.array([i % 2 for i, _ in known], float)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in known])
    scale = x.std(axis=0)
    r = np.random.default_rng(7)
    w, b = r.normal(size=(x.shape[1], 32)) / np.sqrt(x.shape[1]), r.uniform(0, 2 * np.pi, 32)
    def features(v):
        z = np.clip((v - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -8, 8)
        return np.hstack([np.sqrt(2 / 32) * np.cos(z @ w + b), np.ones((len(v), 1))])

    z, n = features(x[~held]), int((~held).sum())
    # ridge as extra rows of a least-squares problem
    extra = np.sqrt(1e-3 * n * np.array([1.0] * 32 + [1e-9]))
    beta = np.linalg.lstsq(np.vstack([z, np.diag(extra)]), np.concatenate([y[~held], np.zeros(33)]), rcond=None)[0]
    s, v = features(x[held]) @ beta, y[held]
    raw = features(quality.vectors([t.encode() for _, t in rows])) @ beta
    expected = np.clip(np.interp(raw, *quality.isotonic(s, v)), 0, 1)
    assert np.allclose([got[i] for i, _ in rows], expected, atol=1e-6)


def test_toxicity_against_dense_steps():
    rng = np.random.default_rng(5)
    dense = (rng.random((60, 12)) < 0.2).astype(float)
    positive, drawn = (rng.random(60) < 0.3).astype(float), (rng.random(60) < 0.8).astype(float)
    prior = 0.2
    weights, bias = toxicity.fit([np.flatnonzero(r) for r in dense], positive, drawn, 12, prior, steps=50)
    w, m, v = np.append(np.zeros(12), np.log(prior / (1 - prior))), np.zeros(13), np.zeros(13)
    x = np.hstack([dense, np.ones((60, 1))])
    for t in range(1, 51):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        loss = lambda sign, part: (x * ((s - 1 if sign > 0 else s) * part / part.sum())[:, None]).sum(axis=0)
        negative = (np.logaddexp(0, z) * drawn).sum() / drawn.sum() - prior * (np.logaddexp(0, z) * positive).sum() / positive.sum()
        rest = loss(-1, drawn) - prior * loss(-1, positive)
        grad = prior * loss(1, positive) + (rest if negative >= 0 else -rest) + 0.04 / positive.sum() * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    assert np.allclose([*weights, bias], w, atol=1e-6) and (weights < 0).any()


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.75)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id").select(label, "score").collect()
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert auc(y, s) >= least and ((s >= 0) & (s <= 1)).all()


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = registry.QUERIES["op10_language_id"](spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_classifiers_without_labels(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(corpus, toxicity.train(corpus, none)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(corpus, quality.train(corpus, none)).collect()} == {0.5}


def test_toxicity_counts_do_not_depend_on_batches():
    rows = [("bad word", True, True), ("word here", False, True), ("word", False, True), ("bad", True, False), (None, False, True)]

    def totals(parts):
        p, u = Counter(), Counter()
        for part in parts:
            for word, a, b in zip(*(c.to_pylist() for c in toxicity.counted(pa.RecordBatch.from_pylist([dict(zip("tpd", r, strict=True)) for r in part], schema=kinds)).columns), strict=True):
                p[word] += a
                u[word] += b
        return p, u

    kinds = pa.schema([("t", pa.string()), ("p", pa.bool_()), ("d", pa.bool_())])
    whole = totals([rows])
    assert whole == totals([[r] for r in rows]) == totals([rows[:2], rows[2:]])
    assert whole[0][b"bad"] == 2 and whole[1][b"word"] == 3 and whole[1][b"bad"] == 1


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    x, y = quality.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-s))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    x, y = quality.isotonic(np.array([0.0, 0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0.0, 0, 1, 0, 1, 1]))
    assert (np.diff(y) > 0).all() and len(x) == len(y) > 1


def test_pooled_blocks_are_the_isotonic_fit():
    rng = np.random.default_rng(6)
    v = rng.random(40)
    s, y, n = quality.pooled(np.arange(40.0), v, np.ones(40))
    # the fit at i is the largest, over starts, of the least mean, over ends
    fit = [max(min(v[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(np.repeat(y, n.astype(int)), fit)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.digest(substrings.with_spans(empty)).count() == 0
    assert jaccard.linked(empty).count() == 0
    assert decontam.scan(empty, [(1, "a b")], decontam.digest, decontam.DIGEST).count() == 0
    assert packing.pack(empty).count() == 0 and media.fingerprint(media.encode(empty)).count() == 0
    assert licenses.inherit(licenses.detect(empty.withColumn("path", F.lit("a")))).count() == 0
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(empty, quality.train(empty, labels)).count() == 0 and toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert langid.predict(empty, langid.train(empty.withColumn("lang", F.lit("en")))).count() == 0
    tokenfile.write(empty, str(tmp_path / "none"))
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,512]"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
