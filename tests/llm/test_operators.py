"""Each operator against a brute-force version, a round trip or held-out labels, with odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tersa.llm import ann, backoff, bpe, chat, knn_quality, licenses, packing, quality_rules, simhash, token_counts
from tersa.llm.common import table
from tersa.llm.queries import QUERIES, ranks, words

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ODD = [None, "", " ", "\n\n", "x", "two words", "a b c d e f g h i j", "same same same same same same", "É ß İ \x1c tab\tx  y z", "the cat\nthe cat\nthe dog", LONG, LONG, "a" * 3000, "Under the MIT License.", "🙂 émoji 漢字 123"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 5, "clash") for i, t in enumerate(ODD)] + [(None, "a null id", "en", None, None, "clash"), (3, "\n\n", None, "s", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def encoder():
    with open(ranks(), "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})


def test_bpe(docs, empty):
    own = encoder()
    want = Counter()
    for i, text in pairs(docs):
        ids = own.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digest(docs, ranks(), public_tokenizers.PATTERN).collect())) == want
    assert bpe.digest(empty, ranks(), public_tokenizers.PATTERN).count() == 0
    both = bpe.decode(bpe.encode(docs, ranks(), public_tokenizers.PATTERN), ranks(), public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in both.collect()) == Counter(pairs(docs))


def test_bpe_of_any_text():
    rng, own, codec = random.Random(3), encoder(), bpe.codec(ranks(), public_tokenizers.PATTERN)
    letters = [chr(c) for c in range(0x2FF) if c] + ["漢", "🙂", "　"]
    block = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["".join(rng.choice("aeht ") for _ in range(900)), "ab" * 400]
    flat, counts = codec.encode_block(block)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [own.encode_ordinary(x) for x in block]


def test_bpe_of_long_pieces():
    rng, own, codec = random.Random(5), encoder(), bpe.codec(ranks(), public_tokenizers.PATTERN)
    names = [t.decode() for t in sorted(own._mergeable_ranks) if t.isalpha() and len(t) > 1]
    block = ["".join(rng.choice(names) for _ in range(200)) for _ in range(60)] + ["".join(rng.choice("aeht") for _ in range(3000)), "a" * 5001, "=" * 2000, " " * 3000 + "x"]
    flat, counts = codec.encode_block(block)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [own.encode_ordinary(x) for x in block]


def shingle_hashes(text, k):
    split = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [xxhash.xxh64_intdigest(" ".join(split[i : i + k]), 42) for i in range(max(1, len(split) - k + 1))] if split else []


def by_links(items, linked):
    forest = list(range(len(items)))

    def root(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                forest[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def test_simhash(spark, docs, empty, small):
    rows = pairs(docs) + [(100 + i, t) for i, (_, t) in enumerate(pairs(table(spark, small, "documents").limit(60)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = []
    for _, text in rows:
        h = shingle_hashes(text, 3)
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    roots = by_links(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((d for (d, _), s in zip(rows, roots, strict=True) if s == r and d is not None), default=None) for r in set(roots)}
    want = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(frame).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rule", [simhash.Rule(tile=64), simhash.Rule(radius=6, limit=6, parts=2, tile=50), simhash.Rule(words=3, radius=20, limit=40, parts=1, tile=37), simhash.Rule(words=2, radius=13, limit=20, parts=1, band=5, tile=61)])
def test_tiles_lose_no_link(spark, rule):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (60, rule.words), dtype=np.uint64)
    rows = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, base.shape, dtype=np.uint64)) for _ in range(5))])
    nodes = np.arange(len(rows))
    frame = spark.createDataFrame([(int(n), r.astype("<u8").tobytes(), 0) for n, r in zip(nodes, rows, strict=True)], "node long, bits binary, weight long")
    got = {r["node"]: r["root"] for r in simhash.linked(frame, rule).collect()}
    forest = simhash.Forest(len(rows))
    for a, b in simhash.near(rows, rows, rule):
        forest.join(a, b)
    assert [got.get(n, n) for n in nodes.tolist()] == forest.up.tolist()


def test_deduplicate(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    long = [rng.sample(vocabulary, 300) for _ in range(6)]
    near = [[*t[:150], "changed", *t[151:]] for t in long]
    rows = [(i, " ".join(t)) for i, t in enumerate(long + near + long[:2])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(6))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and out.where("text = ''").count() + out.where("text is null").count() == 1
    assert simhash.deduplicate(empty).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ann(spark, small):
    vectors = table(spark, small, "embeddings").select("vec_id", "embedding")
    odd = spark.createDataFrame([(9001, None), (9050, [0.0] * 64), (9100, [float("nan")] * 64), (None, [1.0] * 64), (9150, [None] * 64), (0, None), (9200, [1.0])], vectors.schema)
    found = ann.report(vectors.unionByName(odd).unionByName(vectors.limit(7)).withColumn("score", F.lit("clash"))).collect()
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    hits = total = 0
    for q in (i for i in ids if i % 50 == 0):
        near = matrix @ matrix[ids == q][0]
        near[ids == q] = -2
        want = ids[np.lexsort((ids, -near))[:5]].tolist()
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in got] == [1, 2, 3, 4, 5] and all(abs(s - near[ids == v][0]) < 1e-12 for _, v, s in got)
        hits, total = hits + len(set(want) & {v for _, v, _ in got}), total + 5
    assert total and hits / total >= 0.9 and len(found) == total
    assert ann.report(vectors.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0])], vectors.schema)
    assert [tuple(r)[:3] for r in ann.report(two).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_ann_of_copies_and_extremes(spark):
    """A third of all rows is one vector, and a ball of near copies: ties go to the smallest ids; vectors of extreme size score like others."""
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=16) for _ in range(1200)] + [np.ones(16)] * 700 + [np.ones(16) + rng.normal(size=16) * 1e-3 for _ in range(200)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    matrix = np.stack(rows)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    got, hits = {}, 0
    for r in ann.report(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, len(rows), 50):
        near = np.round(matrix @ matrix[q], 12)
        near[q] = -2
        want = np.lexsort((np.arange(len(rows)), -near))[:5].tolist()
        hits += len(set(want) & set(got[q]))
        if np.array_equal(rows[q], np.ones(16)):
            assert got[q] == want
    assert hits / (5 * len(got)) >= 0.95
    small = [(0, [1.0, 0.0]), (50, [1e-170, 0.0]), (1, [1e200, 1.0]), (2, [1e-310, 1e-310]), (3, [0.0, 5.0])]
    extreme = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.report(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()}
    assert len(extreme) == 8 and all(math.isfinite(s) for s in extreme.values())
    assert extreme[0, 50] == extreme[0, 1] == 1.0 and abs(extreme[50, 2] - 0.5**0.5) < 1e-12 and extreme[0, 3] == 0.0


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def licenses_by_hand(texts):
    """n_words, n_base, first_word, last_word, base_labels, labels and score of every text, by the method's definition."""
    split = [license_words(t) for t in texts]
    names = {w for p in (*licenses.BASE, *(t.words for t in licenses.TEMPLATES), *(k for t in licenses.TEMPLATES for k in t.keys)) for w in p.split()}
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in split) + 0.5)) for w in names}
    for own in split:
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        labels, best = {x for _, x in places}, 0.0
        base, starts = ",".join(sorted(labels)), [i for i, _ in places]
        for t in licenses.TEMPLATES:
            sequence = t.words.split()
            rare = sorted({w for w in sequence if w in own}, key=lambda w: (-idf[w], w))[: licenses.PROPOSERS]
            votes = Counter(s for w in rare for s in {i - k for i, x in enumerate(own) if x == w for k, y in enumerate(sequence) if y == w})
            for s in (s for s, n in votes.items() if n > 1 and s >= 0):
                span = own[s : s + len(sequence)]
                if all(f" {k} " in f" {' '.join(span)} " for k in t.keys):
                    score = sum(idf[a] for a, b in zip(sequence, span, strict=False) if a == b) / sum(idf[a] for a in sequence)
                    best = max(best, score)
                    labels |= {t.label} if score >= licenses.ENOUGH else set()
        yield len(own), len(starts), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), round(1.0 if starts else min(best, 1.0), 9)


def test_licenses(spark, docs, empty, small):
    mit, isc, gpl = (next(t.words for t in licenses.TEMPLATES if t.label == x) for x in ("mit", "isc", "gpl-3"))
    rng = random.Random(2)
    extra = [
        "CC-BY-NC under the under the mit license Apache License, Version 2", "license " * 50 + "mit " * 50, "licensed under the GNU General Public License, version 3", "undertheMIT license under the\nMIT--license",
        "We dislike the gnu general public license and version 3 is bad. Texts are licensed under the license version", "under the apache", mit + " " + isc, "x " * 30 + mit.replace("charge", "cost") + " y", isc[5:], gpl.upper() + " " + gpl, "version 3 gnu general public license the under licensed",
    ]
    for t in licenses.TEMPLATES:
        for _ in range(4):
            some = t.words.split()
            for _ in range(rng.randint(0, 4)):
                some[rng.randrange(len(some))] = rng.choice(["the", "license", "x", "gnu", "version"])
            extra.append(" ".join(["w"] * rng.randint(0, 3) + some))
    sample = table(spark, small, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")).unionByName(sample)
    rows = pairs(frame)
    got = licenses.report(frame).collect()
    assert Counter((*tuple(r)[:7], round(r["score"], 9)) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, licenses_by_hand([t for _, t in rows]), strict=True))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[202] == "gpl-3" and labels[204] == "" and labels[206] == "isc,mit" and labels[207] == "mit"
    assert licenses.report(empty).count() == 0
    clash = docs.select("doc_id", "text", *(F.lit("own").alias(c) for c in ("_words", "_hits", "row", "_text", "_found", "labels")))
    out = licenses.scan(clash)
    assert out.columns == ["doc_id", "_words", "_hits", "row", "_text", "_found", *licenses.OUTPUTS] and out.where("_words = 'own' and row = 'own' and _text = 'own'").count() == docs.count()


def features_by_hand(text):
    split = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(split[i : i + 5]) for i in range(len(split) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        covered |= set(range(i, i + 5)) if seen[g] > 1 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(split), "word_chars": sum(map(len, split)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text), "n_exclaims": text.count("!"), "n_distinct": len(set(split)),
    }


def votes_by_hand(f):
    n, chars = f["n_words"], f["word_chars"]
    bad_good = [
        (f["n_symbols"] >= 3 and f["n_symbols"] > 0.08 * n, f["n_symbols"] <= 0.01 * n), (chars < 2.5 * n or chars > 14 * n, 3 * n <= chars <= 9 * n), (f["n_dup_lines"] >= 3 and f["n_dup_lines"] > 0.2 * f["n_lines"], f["n_dup_lines"] == 0),
        (100 * f["n_repeat_words"] > 20 * n, 100 * f["n_repeat_words"] <= 5 * n), (n >= 30 and f["n_distinct"] < 0.2 * n, f["n_distinct"] > 0.35 * n), (f["n_upper"] > 0.3 * chars and n >= 3, f["n_upper"] <= 0.15 * chars),
        (f["n_exclaims"] >= 3 and f["n_exclaims"] > 0.1 * n, f["n_exclaims"] <= 0.02 * n), (n < 3, n >= 100),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in bad_good]


def quality_by_hand(texts):
    """(features, base_failed, quality) of every text: a second implementation, document by document."""
    features = [features_by_hand(t) for t in texts]
    votes = np.array([votes_by_hand(f) for f in features]).reshape(-1, 8) + 1
    quality, weight = np.ones(len(texts)), 1000
    for own in ([0], [1], [2, 3, 4], [5, 6], [7]):
        start = {1: np.tile([0.85, 1.0, 0.15], (len(own), 1)), 0: np.tile([0.015, 1.0, 0.985], (len(own), 1))}  # an abstention has no weight
        now, share = start, 0.05
        for step in range(201):
            like = {c: np.prod([now[c][j][votes[:, k]] for j, k in enumerate(own)], axis=0) for c in now}
            p = share * like[1] / (share * like[1] + (1 - share) * like[0])
            if step == 200 or not len(texts):
                break
            counts = {c: np.array([[(w * (votes[:, k] == v)).sum() for v in range(3)] for k in own]) + weight * prior * start[c] for c, w, prior in ((1, p, 0.05), (0, 1 - p, 0.95))}
            now = {c: np.stack([x[:, 0] / (x[:, 0] + x[:, 2]), np.ones(len(own)), x[:, 2] / (x[:, 0] + x[:, 2])], axis=1) for c, x in counts.items()}
            share = (p.sum() + 0.05 * weight) / (len(texts) + weight)
        quality *= 1 - p
    return [(f, f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"], q) for f, q in zip(features, quality, strict=True)]


def test_quality_rules(spark, docs, empty, small):
    source = table(spark, small, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    frame = docs.select("doc_id", "text").unionByName(source)
    rows = pairs(frame)
    want = quality_by_hand([t for _, t in rows])
    got = quality_rules.judge(frame).collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.FEATURES), r["base_failed"]) for r in got) == Counter((i, *f.values(), b) for (i, _), (f, b, _) in zip(rows, want, strict=True))
    assert sorted((str(r["doc_id"]), r["text"] or "", round(r["quality"], 6), r["kept"]) for r in got) == sorted((str(i), t, round(q, 6), bool(not b and q >= 0.5)) for (i, t), (_, b, q) in zip(rows, want, strict=True))
    assert quality_rules.verdicts(empty).count() == 0
    clash = docs.select("doc_id", "text", *(F.lit("own").alias(c) for c in ("_words", "row", "_text", "_codes", "_places", "quality", "n_words")))
    out = quality_rules.judge(clash)
    assert out.where("_words = 'own' and row = 'own' and _text = 'own' and _codes = 'own' and n_words >= 0 and quality <= 1").count() == docs.count()


def test_estimates_follow_the_data():
    """The same shares at any size give the same model in the limit, whatever was believed first."""
    patterns = {(1, 1, 1, 1, 1, 1, 1, 1): 900, (1, 1, -1, -1, 0, 1, 1, 1): 40, (1, 1, 1, -1, 1, 1, 1, 0): 10, (-1, 1, 1, 1, 1, 1, 1, 1): 50, (1, 1, 0, 0, 1, 1, 1, 1): 100}
    small, large = (quality_rules.estimate({k: n * scale for k, n in patterns.items()}) for scale in (10**4, 10**8))
    assert abs(small["repetition"][0] - large["repetition"][0]) < 0.01 and abs(1 / (1 + math.exp(-large["repetition"][0])) - 0.04) < 0.001

    def quality(model, votes):
        out = 1.0
        for base, rules in model.values():
            out /= 1 + math.exp(base + sum(weights[votes[list(quality_rules.RULES).index(name)]] for name, weights in rules.items()))
        return out

    for votes in patterns:
        assert abs(quality(small, votes) - quality(large, votes)) < 0.01
        # one rule of a kind is outvoted by the two that mostly agree with each other
        assert (quality(large, votes) < 0.5) == (votes[0] == -1 or votes[2] == -1)


def test_quality_rules_against_labels(spark, small):
    folder = small.replace("0.001", "0.01")
    judged = quality_rules.verdicts(table(spark, folder, "documents")).drop("quality").join(table(spark, folder, "labels"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in judged if r["quality"] == 1)
    assert np.mean([not r["kept"] for r in judged if r["quality"] == 0]) >= 0.9


def test_packing(docs, empty):
    own = Tokenizer.from_file(words())
    own.encode_special_tokens = True
    want = Counter()
    rows = packing.pack(docs, words(), with_ids=True).collect()
    for i, text in pairs(docs):
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[i, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids), tuple(part)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert packing.pack(empty, words()).count() == 0


def test_plan_keeps_the_histogram_and_fills():
    rng = random.Random(4)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 2049), 900)}
    plan, seen = packing.plan(histogram), Counter()
    for sequences, times in plan:
        assert sum(n * k for n, k in times.items()) <= 2048
        for n, k in times.items():
            seen[n] += sequences * k
    assert seen == Counter(histogram)
    tokens = sum(n * k for n, k in histogram.items())
    assert tokens / (2048 * sum(s for s, _ in plan)) > 0.97


def test_classifier(spark, docs, empty, small):
    folder = small.replace("0.001", "0.01")
    labels = table(spark, folder, "labels")
    scored = knn_quality.report(table(spark, folder, "documents"), labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    odd = knn_quality.report(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (None, 1, 0), (6, 1, 0)], labels.schema)).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in knn_quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert knn_quality.report(empty, labels).count() == 0


def text_vector(text):
    """A text's trigrams of byte classes and measures, byte by byte."""
    data, out = text.encode(), np.zeros(2058)
    kind = [1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 if b == 32 else 6 + b for b in data]
    for a, b, c in zip(kind, kind[1:], kind[2:], strict=False):
        out[(a * 40503 + b * 2057 + c * 131) * 0x9E3779B97F4A7C15 % (1 << 64) >> 53] += 1
    out[:2048] = np.sqrt(out[:2048] / max(1, len(data) - 2))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, following = max(1, len(words)), list(zip(words, words[1:], strict=False))
    out[2048:] = 1.5 * np.array([
        min(1, math.log1p(len(words)) / 12), 1 - len(set(words)) / n, sum(a == b for a, b in following) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(x.isupper() for x in words) / n,
        min(1, sum(b in b"#*$%&|<>" for b in data) / n), min(1, data.count(b"!") / n), min(1, len(data) / n / 20), min(1, sum(b in b".," for b in data) / n), 1 - len(set(following)) / max(1, len(words) - 1) if len(words) > 1 else 0,
    ])
    return out


def scores_by_hand(texts, known):
    """Score of every text from the labels of the known: doc_id -> (text, label)."""
    rows = np.stack([text_vector(known[i][0]) for i in sorted(known)])
    labels = np.array([known[i][1] for i in sorted(known)])
    weights = np.clip(np.log((len(rows) + 1) / ((rows > 0).sum(axis=0) + 0.5)), 0.3, 4)
    weights[2048:] = 1
    axes = np.linalg.svd(rows * weights, full_matrices=False)[2][:40].T

    def latent(x):
        x = (x * weights) @ axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    near = latent(np.stack([text_vector(t) for t in texts])) @ latent(rows).T
    out = []
    for line in near:
        best = np.argsort(-line)[:15]
        votes = np.maximum(line[best], 1e-6) ** 8
        out.append((votes * labels[best]).sum() / votes.sum())
    return np.array(out)


def known_by_hand(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    return texts, {r["doc_id"]: (texts[r["doc_id"]], float(r["quality"])) for r in table(spark, folder, "labels").collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5}


def test_classifier_votes(spark, small):
    folder = small.replace("0.001", "0.01")
    texts, known = known_by_hand(spark, folder)
    ids = sorted(texts)
    want = dict(zip(ids, scores_by_hand([texts[i] for i in ids], known), strict=True))
    got = {r["doc_id"]: r["score"] for r in knn_quality.report(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()}
    off = [abs(got[i] - want[i]) for i in ids]
    assert got.keys() == want.keys() and np.quantile(off, 0.99) < 1e-3 and np.mean([(got[i] >= 0.3) == (want[i] >= 0.3) for i in ids]) > 0.999  # ties at the fifteenth neighbour


def test_token_counts(docs, empty):
    own = encoder()
    sizes = [len(own.encode_ordinary(t)) for _, t in pairs(docs)]
    rows = {r["n_tokens"]: r for r in token_counts.token_counts(docs, ranks(), public_tokenizers.PATTERN).collect()}
    assert rows.keys() == set(sizes) | set(token_counts.LIMITS)
    for n, r in rows.items():
        assert (r["n_docs"], r["docs_from"], r["tokens_from"]) == (sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r["truncated_tokens"], r["total_tokens"]) == (sum(min(s, n) for s in sizes), sum(sizes))
        assert abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    answers = token_counts.token_counts(docs, ranks(), public_tokenizers.PATTERN, (7,))
    for n in (0, 1, 4, 7, 100, 10**6):
        r = token_counts.at(answers, n).first()
        assert (r["docs_from"], r["tokens_from"], r["truncated_tokens"]) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
        assert abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    none = token_counts.token_counts(empty, ranks(), public_tokenizers.PATTERN)
    assert none.count() == 0 and token_counts.at(none, 5).count() == 0


def test_chat(spark):
    texts = ["", None, "plain", chat.PROBE, "<\\s> [\\\\INST]", "<<SYS>>", "a" * 100_000, "\\", "</s", "</", "s>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "<<:>>"]), rng.choice(texts), "x") for c in range(30) for t in range(rng.randint(1, 8))] + [(None, 0, "user", "x", "x"), (4, None, "user", "y", "x")] + [(5, 1, "user", "twice", "x")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.report(turns).collect()}
    by = {}
    for c, t, role, text, _ in [*rows, (-1, 0, "user", chat.PROBE, ""), (-1, 1, "assistant", chat.PROBE, "")]:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, x)) for *_, r, x in own)
    whole = {}
    for r in chat.format_conversations(turns).collect():
        assert r["start"] == len(whole.get(r["conv_id"], ""))
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
        assert (r["loss_start"] is not None) == (r["role"] == "assistant")
        assert r["loss_start"] is None or chat.unescape(whole[r["conv_id"]][r["loss_start"] : r["loss_end"]]) == r["text"]
    for c, text in whole.items():  # the joined conversation, read at once and in pieces of every size
        want = [x[2:] for x in by[c]]
        assert [t[:2] for t in chat.parse(text)] == want
        for size in (1, 7) if len(text) < 5000 else (977,):
            reader = chat.Reader()
            assert [t[:2] for i in range(0, len(text), size) for t in reader.feed(text[i : i + size])] == want
            reader.close()
    assert [r["conv_id"] for r in chat.report(turns.limit(0)).collect()] == [-1]


def test_chat_parser_refuses():
    for text in ("x", "<s>a", "<s>a[/INST]", "[INST]a<s>b</s>[/INST]", "<<ROLE>>x", "<s>a</s>x", "<s>a</s><", "<"):
        with pytest.raises(chat.Broken):
            chat.parse(text)


def scores_of_words(rows, own, seen, order=3, alpha=0.4):
    """(doc_id, words, log score) of every row, word by word, by the definition."""
    split = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()) for i, t in rows]
    grams = [[tuple(w[k : k + n]) for k in range(len(w) - n + 1)] for n in range(1, order + 1) for _, w in split]
    every = Counter(g for line in grams for g in line)
    total = sum(len(w) for _, w in split)
    for i, w in split:
        mine = Counter() if own else Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        score = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                count = every[gram] - mine[gram]
                if n == 1:
                    score += math.log(max(count, 1) / max(1, total - (0 if own else len(w))))
                elif count >= seen:
                    score += math.log(count / (every[gram[:-1]] - mine[gram[:-1]]))
                    break
                else:
                    score += math.log(alpha)
        yield i, len(w), score


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    return [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) <= 1e-9 * max(1, abs(b[2])) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize(("ranges", "own", "seen"), [(1, False, 1), (7, False, 1), (5, True, 1), (5, True, 2)])
def test_lm_scores(spark, docs, empty, small, ranges, own, seen):
    frame = docs.select("doc_id", "text").unionByName(table(spark, small, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = backoff.lm_scores(frame, ranges, seen, own)
    assert alike(got.select("doc_id", "n_words", "log_score").collect(), scores_of_words(pairs(frame), own, seen))
    assert backoff.lm_scores(empty).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("tersa_blocks")]


def test_pipeline(spark, small):
    """run() against a second implementation of every stage."""
    rows = corpus_pipeline.run(spark, small).collect()
    texts, known = known_by_hand(spark, small)
    ids = sorted(texts)
    kept = [i for i, s in zip(ids, scores_by_hand([texts[i] for i in ids], known), strict=True) if s >= 0.3]
    kept = [i for i, (_, failed, q) in zip(kept, quality_by_hand([texts[i] for i in kept]), strict=True) if not failed and q >= 0.5]
    roots = by_links([set(shingle_hashes(texts[i], 5)) for i in kept], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    kept = {kept[r] for r in roots}
    own = Tokenizer.from_file(words())
    own.encode_special_tokens = True
    want = Counter()
    for i in kept:
        ids = [*own.encode(texts[i], add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[i, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


CLASHES = ["score", "predicted", "quality", "kept", "n_words", "key", "size", "slot", "bitmap", "asked", "known", "chosen", "stays", "node", "bits", "weight", "root", "row", "_id", "_key", "_text", "_words", "_lines", "_hot", "ids", "decoded", "start", "rank", "serial", "doc_tokens", "length", "a.b"]


def test_stages_bear_odd_rows(spark, docs, empty, small):
    """Every stage keeps the rows it keeps as they are, whatever their columns are called."""
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES if c != "score"))
    whole = {str(r) for r in wide.collect()}
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, small)
        if name == "packing":
            assert out.count() == stage(spark, plain, small).count()
            continue
        got = out.collect()
        assert out.schema == wide.schema and {str(r) for r in got} <= whole
        ids = Counter(r["doc_id"] for r in got)
        assert ids == Counter(r["doc_id"] for r in stage(spark, plain, small).collect())
        assert stage(spark, wide.limit(0), small).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, empty, small).collect() == []


def test_deduplicate_by_exact_jaccard(spark):
    """Pairs around a Jaccard index of 0.8, of equal size and of unequal size, and sets whose bits are alike by repetition only."""
    rng = random.Random(12)
    rows, want = [], set()

    def add(*documents):
        first = len(rows)
        rows.extend((first + i, " ".join(x)) for i, x in enumerate(documents))
        sets = [set(shingle_hashes(x, 5)) for _, x in rows[first:]]
        want.update(first + i for i in range(len(sets)) if by_links(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))[i] == i)

    for _ in range(12):
        for away in range(14, 52):  # the first words differ: sets of 200 shingles each that share 200 - away
            shared, *ends = [f"w{rng.randrange(10**9)}" for _ in range(204 - away)], *([f"w{rng.randrange(10**9)}" for _ in range(away)] for _ in range(2))
            add(ends[0] + shared, ends[1] + shared)
    for _ in range(40):
        text = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        add(text, text[: 4 + rng.randint(70, 90)])
    line = [f"r{i}" for i in range(10)]
    for _ in range(5):
        a, b = ([f"w{rng.randrange(10**9)}" for _ in range(40)] for _ in range(2))
        add(a + line * 40, b + line * 40)
        c = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        add(c + line * 2, ["z", *c[1:]] + line * 40)
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < len(rows)


def test_set_links():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 40, 30, dtype=np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 8], 30 - i % 7, replace=False), rng.integers(0, 1 << 40, i % 5, dtype=np.uint64)])) for i in range(150)] + [base[0][:0]] * 2
    forest = simhash.Forest(len(sets))
    forest.join(*map(np.array, simhash.set_links(sets, (4, 5))))
    own = [set(x.tolist()) for x in sets]
    assert forest.up.tolist() == by_links(own, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))


def test_parts_of_a_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "EACH", 1 << 20)
    rng = random.Random(3)
    text = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(text))]
    for i in range(1, 25):  # a chain of changes: each like the one before, the first and last not alike
        text[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(text)))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_near_duplicate_stage_by_exact_jaccard(spark, small):
    source = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    ids = sorted(texts)
    roots = by_links([set(shingle_hashes(texts[i], 5)) for i in ids], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    kept = corpus_pipeline.near_duplicates(spark, source, small).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({ids[r] for r in roots})


def test_repeated_rows_spread(spark):
    """Equal rows, and a null doc_id, are packed and deduplicated like any others."""
    frame = spark.createDataFrame([(None, "same text of a hot row")] * 3000 + [(7, "another text")], "doc_id long, text string")
    pieces = packing.cut(frame, words()).collect()
    assert len({r["serial"] for r in pieces}) == 3001
    rows = packing.pack(frame, words()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3001
    assert Counter(r["doc_id"] for r in simhash.deduplicate(frame).collect()) == {None: 1, 7: 1}


def test_lm_query(spark, small):
    got = QUERIES["op10_lm_scores"](spark, small).select("doc_id", "n_words", "log_score").collect()
    assert alike(got, scores_of_words(pairs(table(spark, small, "documents")), False, 1))


def test_counts_beyond_32_bits(spark):
    values = np.array([0, 1, (1 << 32) + 5, 7 << 40], dtype=np.int64)
    assert backoff.counts_unpacked(backoff.counts_packed(values), 4).tolist() == values.tolist()
    assert backoff.counts_unpacked(backoff.counts_packed(values[:0]), 0).tolist() == []
    key, most = np.array([5], dtype=np.uint64), (1 << 32) - 1
    sent = [(0, b, 1, backoff.packed(key), backoff.counts_packed(np.array([most], dtype=np.int64))) for b in range(2)]
    answers = backoff.count(spark.createDataFrame(sent, backoff.KEYS)).collect()
    assert [int(backoff.counts_unpacked(r["counts"], 1)[0]) for r in answers] == [2 * most] * 2
