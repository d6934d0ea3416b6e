"""Near-copy fingerprints, whitening and spelling variants against brute force."""

import itertools
import math
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from compare import connect, rows
from pyspark.sql import functions as F

from chronoloom.llm import html_text, license_scan, simhash, spelling, whitening
from chronoloom.llm.common import read_table
from chronoloom.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "über Den 1st Wall " * 40_000
ODD = [None, "", " \n\t ", "one", "A a a", "two parts kept", "x" * 70_000, LONG, LONG + "end", "é😀 ß naïve — text", "\x00\x01 a", "same text here for all", "Same  text\nhere for all", "Déjà voilà DÉJÀ ÷×"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, n long")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 11


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_copies(texts):
    fp = {i: fingerprint(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    part = components(fp, near)
    return {(i, f"{fp[i]:016x}", part[i]) for i in fp}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg ") for _ in range(900)) for _ in range(12)]
    near = [t[:400] + rng.choice("xyz") + t[401:] for t in base for _ in range(6)]
    texts = ODD + base + near + base[:3]
    got = {tuple(x) for x in simhash.near_copies(docs(spark, texts)).collect()}
    assert got == brute_copies(texts)
    assert len({x[2] for x in got}) < len(texts) - 10


def test_near_copies_of_the_given_table(spark, data):
    given = read_table(spark, data, "documents").orderBy("doc_id").select("doc_id", "text").collect()
    got = {tuple(x) for x in QUERIES["op11_simhash"](spark, data).collect()}
    expected = brute_copies([x["text"] for x in given])
    ids = [x["doc_id"] for x in given]
    assert got == {(ids[i], f, ids[c]) for i, f, c in expected}


@pytest.mark.parametrize("long_list", [2, 7, 512])
def test_posting_lists_of_any_length_lose_no_link(spark, long_list):
    rng = random.Random(long_list)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = set(seeds) | {s ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for s in seeds[:40]} | {s ^ 7 << rng.randrange(60) for s in seeds}
    # a family in the low two bytes and the top one: 4096 fingerprints of one posting list
    prints |= {seeds[0] & ~0xFF00000000000FF0 | x << 4 & 0xFF0 | y << 60 for x in range(256) for y in range(4)}
    prints |= {seeds[1] & ~0b1111111 | x for x in range(128) if x.bit_count() % 3 == 0}
    signed = [(x - (x >> 63 << 64),) for x in prints]
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links_between(spark.createDataFrame(signed, "fp long"), long_list).collect()]
    assert components(prints, got) == components(prints, [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 2])
    assert len(got) < 12 * 6 * len(prints)


def test_near_copies_of_odd_ids_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "d e f"), (7, "d e f"), (9, "g"), (9, "g"), (None, None), (4, None)], "doc_id long, text string")
    got = sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in simhash.near_copies(table).collect())
    assert got == [(-1, -1), (-1, -1), (4, 4), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 12


def brute_whitening(vectors, k=4):
    """By the library's own eigenvectors: (id, component) -> (n, deviation, |whitened|, explained)."""
    kept = {i: np.array([math.floor(256 * float(c)) for c in v], dtype=np.int64) for i, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.unique(np.stack(list(kept.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept.items():
        for j in range(min(k, len(e))):
            value, vector = e[-1 - j], v[:, -1 - j]
            out[i, j + 1] = (n, int(((n * x - s) ** 2).sum()), abs((x - s / n) @ vector) / np.sqrt(value), value / e.sum())
    return out


def test_whitening_of_the_given_table_equals_eigenvectors(spark, data):
    given = {x["vec_id"]: x["embedding"] for x in read_table(spark, data, "embeddings").collect()}
    expected = brute_whitening(given)
    got = QUERIES["op12_whitening"](spark, data).collect()
    assert len(got) == len(expected)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - whitened) < 1e-8 and abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-9
        signs.setdefault(r["component"], []).append(r["whitened"])
    # one sign for all rows: whitened columns are uncorrelated
    w = np.array([signs[c] for c in sorted(signs)])
    assert w.shape[0] == 4


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = {i: (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist() for i in range(300)}
    odd = {1000: None, 1001: [1.0, None, 1.0, 1.0, 1.0, 1.0], 1002: [float("nan")] * 6, 1003: [float("inf")] + [0.0] * 5, 1004: [], 1005: good[3], 1006: good[3]}
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in {**good, **odd}.items()], "vec_id long, embedding array<double>, n string, x long")
    expected = brute_whitening({**good, 1005: good[3], 1006: good[3]})
    got = whitening.whiten(table).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == set(expected)
    for r in got:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(abs(r["whitened"]) - whitened) < 1e-9 and abs(r["explained"] / explained - 1) < 1e-9
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0


def test_whitening_without_rank_and_of_several_lengths(spark):
    table = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [0.0, 1.0, 2.0]), (4, [0.0, 3.0, 2.0]), (None, [0.0, 3.0, 2.0]), (5, [1e300, 0.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table).collect()}
    assert len(got) == 2 + 2 + 3 * 3 + 2 * 4
    assert got[1, 1]["n"] == 1 and got[1, 1]["whitened"] is None and got[1, 1]["deviation"] == 0 and got[1, 1]["explained"] == 0
    assert got[3, 1]["n"] == 2 and abs(abs(got[3, 1]["whitened"]) - 1) < 1e-12 and got[3, 2]["whitened"] is None and got[None, 1]["whitened"] == got[4, 1]["whitened"]
    assert got[5, 1]["deviation"] is None and abs(abs(got[5, 1]["whitened"]) - 1) < 1e-9


@pytest.mark.parametrize("e", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [7, 7, 2, 2, 2], [1e12, 3, 2, 1e-9], [4, 0, 0, 0, 0, 0], [3, 3 + 1e-7, 3 - 1e-7, 1], [0, 0, 0], list(range(1, 65)), [2]])
def test_divide_and_conquer_equals_eigenvalues(e):
    q, _ = np.linalg.qr(np.random.default_rng(len(e)).standard_normal((len(e), len(e))))
    a = q @ np.diag(np.array(e, dtype=float)) @ q.T
    a = (a + a.T) / 2
    for k in (1, 4, len(e)):
        values, vectors = whitening.leading_components(a, k)
        expected = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
        size = max(1.0, np.abs(e).max())
        assert np.allclose(values, expected, atol=1e-12 * size, rtol=0)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * size


def test_polar_factor_is_orthogonal_and_squares_to_one():
    a = np.random.default_rng(1).standard_normal((20, 20))
    u = whitening.polar_factor(a + a.T)
    e, v = np.linalg.eigh(a + a.T)
    assert np.allclose(u, v @ np.diag(np.sign(e)) @ v.T, atol=1e-10)


# 13


def brute_words(texts, every=97):
    out = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [x for x in counts if x != w and is_near(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            form[w] = best if counts[best] >= 2 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, n, f, counts[f] if f else None, root, len(near[w])))
    return out


def test_variants_match_sql(spark, data):
    assert rows(QUERIES["op13_spelling"](spark, data).toPandas()) == rows(connect(data).sql(ORACLES["op13_spelling"]).df())


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_variants_equal_brute_force(spark, block):
    rng = random.Random(block)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 12))) for _ in range(60)] + ["x" * n for n in range(5, 12)] + ["longer" * 300]
    words = stems + [w[:i] + rng.choice(["", "a", "bc", "ÿ"]) + w[i + 1 :] for w in stems for i in rng.sample(range(len(w)), 3)]
    texts = [(i, " ".join(rng.choices(words, k=60)) + rng.choice([".", ", ", "×1 ", "ĀĀ"])) for i in range(80)]
    texts += [(None, "Ordre ordre ORDRE ordré"), (7, None), (8, ""), (9, "über überr überr überr " * 3), (9, "über überr überr überr " * 3)]
    table = spark.createDataFrame([(i, t, 1, "m") for i, t in texts], "doc_id long, text string, n long, word string")
    got = {tuple(x) for x in spelling.spelling_variants(table, every=7, block=block).collect()}
    assert got == brute_variants(brute_words(texts, 7))
    assert any(x[5] > 2 for x in got) and any(x[2] for x in got)


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 7, "aaabb": 15, "aabbb": 40, "abbbb": 90, "aaaac": 7, "zzzzz": 5, "zzzzy": 9}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    got = {x["word"]: x for x in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=1 << 33).collect()}
    assert got["aaaaa"]["form"] == "aaaab" and got["aaaaa"]["root"] == "abbbb" and got["zzzzz"]["form"] is None and got["zzzzz"]["n_near"] == 1
    assert {tuple(x) for x in got.values()} == brute_variants(counts)


def test_whole_texts_are_counted(spark):
    long = "alpha Beta÷gamma déjàvu " * 50_000
    table = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, "x" * 300_000), (4, "x" * 299_999 + " ok"), (5, "x" * 300_000)], "doc_id long, text string")
    got = {x["word"]: x["n"] for x in spelling.count_words(table).collect()}
    assert got == brute_words([(x["doc_id"], x["text"]) for x in table.collect()])
    assert spelling.spelling_variants(table.where("false")).count() == 0


def test_no_driver_sized_results(spark, data):
    plan = QUERIES["op13_spelling"](spark, data)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    assert QUERIES["op11_simhash"](spark, data).where(F.col("component_id") > F.col("doc_id")).isEmpty()


# Inputs that once took a time with the square of their length


@pytest.mark.parametrize("text", [" " * 200_000, "\t" * 200_000, "　" * 200_000, "a" + " " * 100_000 + "b", "▁ " * 20_000])
def test_long_runs_of_white_space_are_encoded_as_by_the_library(text):
    import sentencepiece

    from chronoloom.llm.queries import tokenizer_path
    from chronoloom.llm.sentencepiece_codec import Codec

    start = time.process_time()
    got = Codec(tokenizer_path()).ids(text)
    assert time.process_time() - start < 30
    assert got == sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()).encode(text)


@pytest.mark.parametrize("part", ["<!--", "<!", "<a ", "</", "<?", "<p>seen<!--"])
def test_markup_without_an_end_is_read_in_proportion(part):
    start = time.process_time()
    text = html_text.main_text("<p>Plain words of a page.</p>" + part * 100_000)
    assert time.process_time() - start < 10 and text.startswith("Plain words of a page.") and "<" not in text
    assert html_text.main_text("<p>Plain words of a page.</p>" + part * 100_000 + "></p>") is not None


def test_repeated_notices_are_scanned_in_proportion(spark):
    one = "Licensed under the MIT License\n"
    start = time.perf_counter()
    got = license_scan.scan_licenses(docs(spark, [one * 20_000, one])).orderBy("doc_id").collect()
    assert time.perf_counter() - start < 60
    assert (got[0]["n_base"], got[1]["n_base"]) == (20_000, 1) and got[0]["labels"] == got[1]["labels"] == "mit" and got[0]["last_word"] == 5 * 19_999 + 3
