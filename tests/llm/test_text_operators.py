"""Text operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from chronoloom.llm import chat, decontamination, html_text, license_scan, neighbours, ngram_join, pii, quality, sentencepiece_codec, toxicity, words
from chronoloom.llm.common import read_table
from chronoloom.llm.queries import ORACLES, QUERIES, tokenizer_path

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "über Den 1st Wall " * 40_000
ODD = [None, "", " \n\t ", "one", "A a a", "The mit license and THE MIT LICENSE", "x" * 70_000, LONG, "é😀 ß naïve — text", "\x00\x01 a", "same text here for all of us today", "same text here for all of us today"]


def docs(spark, texts, **more):
    extra = "".join(f", {k} {v}" for k, v in more.items())
    return spark.createDataFrame([(i, t, *([None] * len(more))) for i, t in enumerate(texts)], "doc_id long, text string" + extra)


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def given(spark, data):
    return read_table(spark, data, "documents").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# Words

def test_word_hashes_follow_the_words():
    texts = ["Ab ab AB", "x1é-é x1 É", "", "a"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    found = words.split_words(np.frombuffer(b"".join(data), np.uint8), offsets)
    expected = [w for t in texts for w in words_of(t)]
    assert len(found.hash) == len(expected)
    for i, a in enumerate(expected):
        for j, b in enumerate(expected):
            assert (found.hash[i] == found.hash[j]) == (a == b)
    assert found.doc.tolist() == [d for d, t in enumerate(texts) for _ in words_of(t)]


# 1

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
]


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_of(text):
    found = sorted((m.start(), k, m.end()) for k, (_, r, ok) in enumerate(BASE) for m in re.finditer(r, text or "") if ok(m[0]))
    joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
    return (*[sum(x[1] == k for x in found) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()), joined


def test_personal_data(spark, given):
    r = random.Random(5)
    bits = ["1", "12", ".", "@", "a", "-", " ", "+", "é", "4111111111111111", "+1 555 123 4567", "x@y.z", "255", "\n", "(", ")"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(300)]
    made += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111-1", "+1 4111 1111 1111 1111"]
    for df in (docs(spark, ODD + made), given):
        got = {x["doc_id"]: x for x in pii.find_personal_data(df).collect()}
        for x in df.collect():
            g = got[x["doc_id"]]
            want, joined = base_of(x["text"])
            assert (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"], g["base_sha256"]) == want
            assert [s for s in g["spans"].split(",") if s and not s.startswith("term")] == [s for s in joined.split(",") if s]


def test_disclosing_words_and_sanitising(spark, empty):
    texts = [f"filler{i % 7} the boss zyxword uses ann@corp.example.com daily the filler{i}" for i in range(4)] + [f"the common filler{i} text the boss" for i in range(60)]
    df = docs(spark, texts, row_key="string", terms="string", n_chars="long")
    out = {x["doc_id"]: x for x in pii.sanitise(df).collect()}
    assert out[0]["text"] == "filler0 the boss <TERM> <TERM> <EMAIL> <TERM> the filler0"
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[0]["row_key"] is None
    assert out[30]["text"] == texts[30]
    assert pii.find_personal_data(empty).count() == 0
    kept = pii.sanitise(docs(spark, ODD)).orderBy("doc_id").collect()
    assert [x["text"] for x in kept] == ODD


def test_disclosing_words_of_whole_documents(spark):
    far = " ".join(["the common text"] * 40)
    texts = [f"Zyxword q7 li {far} ann@corp.example.com {far} zyxword the filler{i}" for i in range(4)]
    texts += [f"the common text filler{i} of x" for i in range(59)] + ["the common text ZYXWORD stands alone here"]
    df = docs(spark, texts)
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(df).collect()}
    assert out[0] == f"<TERM> <TERM> <TERM> {far} <EMAIL> {far} <TERM> the filler0"
    assert out[63] == "the common text <TERM> stands alone here"
    assert out[30] == texts[30]


def test_disclosing_words_against_brute_force(spark, given):
    word = re.compile(r"[^\W_]+")
    rows_ = [(x["doc_id"], x["text"] or "") for x in given.collect() if (x["text"] or "").isascii()]
    all_words, all_values = {}, {}
    for i, t in rows_:
        plain = list(t)
        spans = [(m.start(), m.end(), k, m[0]) for k, (_, r, ok) in enumerate(BASE) for m in re.finditer(r, t) if ok(m[0])]
        for a, b, _, _ in spans:
            plain[a:b] = " " * (b - a)
        all_words[i] = [(m.start(), m.end(), m[0].lower()) for m in word.finditer("".join(plain))]
        all_values[i] = {(k, digits(v) if k >= 2 else v.lower()) for _, _, k, v in spans}
    with_word = Counter(w for x in all_words.values() for w in {y[2] for y in x})
    with_value = Counter(v for x in all_values.values() for v in x)
    both = Counter((v, w) for i, x in all_values.items() for w in {y[2] for y in all_words[i]} for v in x)
    n = len(rows_)
    found = {w for (v, w), k in both.items() if k >= 2 and with_value[v] < n and np.log2(k * n / (with_value[v] * with_word[w])) >= np.log2(n / with_value[v]) / 1.25}
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("term")] for x in pii.find_personal_data(df).collect()}
    assert found and got == {i: [x[:2] for x in own if x[2] in found] for i, own in all_words.items()}


def test_very_many_spans_in_one_text(spark):
    """Ten times the spans take about ten times as long, cuts and places are right."""
    r = random.Random(7)
    bits = ["ann{}@corp.example.com", "1.2.3.{}", "+1 555 123 {:04}", "4111 1111 1111 1111", "wörd{}", "(x)", "é"]
    took = {}
    for n in (2_000, 20_000):
        text = " ".join(r.choice(bits).format(r.randint(0, 255)) for _ in range(2 * n))
        df = docs(spark, [text], n_chars="int").cache()
        df.count()
        start = time.perf_counter()
        found = pii.find_personal_data(df).first()
        took[n] = time.perf_counter() - start
        want, joined = base_of(text)
        assert (found["n_email"], found["n_ip"], found["n_card"], found["n_phone"], found["base_sha256"]) == want and found["spans"] == joined
        spans = [s.split(":") for s in joined.split(",")]
        out, at = "", 0
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert pii.sanitise(df).first()["text"] == out + text[at:]
    print(took)
    assert took[20_000] < 20 * took[2_000]


def test_copies_with_very_many_values_and_words(spark):
    """Copies that share n values and n words make few pairs of classes."""
    took = {}
    for n in (2_000, 20_000):
        own = " ".join(f"a{i}@corp.example.com w{i} common" for i in range(n))
        texts = [own, own, own + " w0 left"] + [f"the common text {i}" for i in range(20)] + ["w7 w8 of the other text"]
        df = docs(spark, texts)
        start = time.perf_counter()
        got = {x["doc_id"]: x for x in pii.find_personal_data(df).collect()}
        took[n] = time.perf_counter() - start
        assert [got[i]["n_email"] for i in range(4)] == [n, n, n, 0]
        assert [got[i]["n_term"] for i in (0, 1, 2, 3, 23)] == [n, n, n + 1, 0, 2]
        assert got[23]["spans"] == "term:0:2,term:3:5"
        at = own.index("w1234 ")
        assert f"term:{at}:{at + 5}" in got[0]["spans"].split(",")
    print(took)
    assert took[20_000] < 20 * took[2_000]


# 2

def decoder_of(spark, given):
    return toxicity.Decoder(toxicity.trigram_model(given.select("text").union(docs(spark, ["you are an idiot and a stupid loser, moron, clown, worthless trash, so pathetic and disgusting scum"] * 30).select("text"))))


def test_deobfuscation(spark, given):
    d = decoder_of(spark, given)
    assert d.restored("an 1d10t here") == ["idiot"]
    assert d.restored("m.o.r.o.n") == ["moron"]
    assert d.restored("what a looooser") == ["loser"]
    assert d.restored("w0rthless")[0] in ("worthless", "worthles")  # as the few words of this model have it
    for text, word in (("s t u p i d", "stupid"), ("s  t  u  p  i  d", "stupid"), ("st-up-id", "stupid"), ("you stuupid", "stupid"), ("idi07 (x)", "idiot"), ("an idi0t!", "idiot"), ("5cum", "scum"), ("l00ser.", "looser")):
        assert word in d.restored(text)
    assert d.restored("plain words, 12 of them (a b)") == []


def test_decoding_equals_exhaustive_search(spark, given):
    d = decoder_of(spark, given)
    r = random.Random(6)

    def best(token):
        found = {}

        def go(i, a, b, score, out):
            if i == len(token):
                found[out] = max(found.get(out, -np.inf), score + d.log[a][b][0])
                return
            for symbol, letter, cost in d.readings(token[i], token[i - 1] if i else "", token[max(0, i - 2) : max(0, i - 1)] + token[i + 1 : i + 2]):
                if symbol is None:
                    go(i + 1, a, b, score - cost, out)
                else:
                    go(i + 1, b, symbol, score - cost + d.log[a][b][symbol], out + letter)

        go(0, 0, 0, 0.0, "")
        return found

    for _ in range(150):
        token = "".join(r.choice("aabeiorst013$*!-é") for _ in range(r.randint(1, 9)))
        found = best(token)
        assert found[d.decode(token)] == pytest.approx(max(found.values()))
    # a letter that stands twice: the shortcut says what the lattice says
    for _ in range(400):
        a, x, b = ("".join(r.choice("abcdeilmnorstu") for _ in range(n)) for n in (r.randint(0, 3), 1, r.randint(0, 3)))
        if x in (a[-1:], b[:1]) or any(y[0] == y[1] for z in (a, b) for y in zip(z, z[1:], strict=False)):
            continue
        word = a + x + x + b
        assert bool(len(d._suspect(np.frombuffer(f"é {word} b".encode(), np.uint8), np.array([0, len(word) + 5])))) == (d.decode(word) != word)


def labelled_case(spark):
    bad = ["zorgle", "blimfut"]
    r = random.Random(2)
    plain = lambda: " ".join(f"w{r.randint(0, 200)}x" for _ in range(60))
    rows_ = []
    for i in range(400):
        toxic = i % 5 == 0
        text = plain() + (" " + " ".join(r.choice(bad) for _ in range(3)) + " " + plain() if toxic else "")
        rows_.append((i, text, int(toxic)))
    df = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_held_out(spark, empty):
    df, labels = labelled_case(spark)
    found = toxicity.score_toxicity(df, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50 and all(x["predicted"] == x["toxic"] for x in found)
    kept = toxicity.without_toxic(df.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 320
    far = docs(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000)  # none of them has a label
    odd = toxicity.score_toxicity(far, labels).collect()
    assert len(odd) == len(ODD) and all(x["score"] == 0 and x["predicted"] == 0 for x in odd)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    hidden = df.withColumn("text", F.regexp_replace("text", "zorgle", "z0rgl3"))
    again = toxicity.score_toxicity(hidden, labels).join(labels, "doc_id").collect()
    assert np.mean([x["predicted"] == x["toxic"] for x in again]) > 0.97


def test_toxicity_scores_against_brute_force(spark, given):
    decoder = decoder_of(spark, given)
    names = {("word", "idiot"): 5.0, ("word", "und"): 2.5, (4, "stup"): 3.0, (5, "the a"): 9.0, (6, "moroni"): 4.0, ("word", "ü"): 7.0, (4, "mo"): 1.0}
    def prefix_hash(k, w):
        raw = np.frombuffer((w + "x").encode(), np.uint8)
        found = words.split_words(raw, np.array([0, len(raw)]))
        return words.mix(words.span_hash(found.sums, np.array([0]), np.array([k])) + np.uint64(k))[0]

    usable = {n: v for n, v in names.items() if " " not in n[1] and (n[0] == "word" or len(n[1].encode()) == n[0])}
    hashes = np.array([words.hash_words([w])[0] if k == "word" else prefix_hash(k, w) for k, w in usable], dtype=np.uint64)
    order = np.argsort(hashes)
    model = toxicity.Lexicon(hashes[order], np.array(list(usable.values()))[order])
    texts = ["An 1d10t is stupid, stupidly STUPID", "the moronic moronic moron und und", "", "ü Ü idiot", "s t u p i d und", "stup stupx"] + [x["text"] or "" for x in given.limit(40).collect()]
    import pyarrow as pa

    got = model.summary(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text", decoder)
    for text, row in zip(texts, got, strict=True):
        every = words_of(text) + decoder.restored(text)
        best = {}
        for w in set(every):
            own = [v for (k, name), v in usable.items() if (w == name if k == "word" else len(w.encode()) > k and w.encode()[:k] == name.encode())]
            if own:
                best[w] = max(own)
        total = sum(best.values())
        want = [min(total, 60), max(best.values(), default=0), np.log1p(len(best)), np.log1p(100 * total / max(len(every), 20)), np.log1p(len(every))]
        assert row == pytest.approx(want)


@pytest.mark.parametrize("form", ["z0rgl3", "zorgg-le", "z o r g l e", "zzorrglee", "zo-rg-le"])
def test_restored_words_decide(spark, form):
    """Held-out rows write their toxic word over; what they are found by is the decoder."""
    df, labels = labelled_case(spark)
    hide = (toxicity.remainder(F.col("doc_id"), 4) == 2) & (F.col("doc_id") % 3 == 0)
    hidden = df.withColumn("text", F.when(hide, F.regexp_replace("text", "zorgle|blimfut", form)).otherwise(F.col("text")))
    found = toxicity.score_toxicity(hidden, labels).join(labels, "doc_id").where("held_out and doc_id % 3 = 0").collect()
    assert sum(x["toxic"] for x in found) > 4 and all(x["predicted"] == x["toxic"] for x in found)


def test_repeated_ids_leave_the_sample_bounded(spark):
    df, labels = labelled_case(spark)
    once = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(df, labels).collect()}
    again = df.union(df.where("doc_id < 100")).union(df.where("doc_id < 100"))
    found = toxicity.score_toxicity(again.withColumn("label", F.lit(1)), labels.union(labels)).collect()
    assert len(found) == 600 and all(x["score"] == pytest.approx(once[x["doc_id"]], abs=1e-3) for x in found)


# 3

def test_pages(spark, data):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="sidebar">Links</div><article><h1>Head &amp; line</h1><p>First  para<b>graph</b>\n that is long enough to count as text of the page.<p>Tiny.<ul><li>one<li>two</ul><div class="ad">Buy!</div><form>name</form></article><div id="comments"><p>Nice post, thank you for it, it was a pleasure to read.</p></div><footer>&copy; x</footer>'
    expected = "Head & line\n\nFirst paragraph that is long enough to count as text of the page.\n\nTiny.\n\none\n\ntwo"
    assert html_text.main_text(page) == expected
    assert html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<div class=menu>m</div><div><p>Body text of some length here.</p>tail</div>") == "Body text of some length here.\n\ntail"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (3, "v", "", "x"), (4, "w", "<p>" + "long text " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).orderBy("page_id").collect()
    assert [(x["page_id"], x["n_chars"]) for x in got] == [(1, len(expected)), (2, 0), (3, 0), (3, 0), (4, 499_999)]
    assert html_text.extract_pages(df.limit(0)).count() == 0
    for x in read_table(spark, data, "pages").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", x["html"], re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"</?(b|br)\b[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h\d)\b[^>]*>", body)]
        assert html_text.main_text(x["html"]) == "\n\n".join(p for p in parts if p)


LONG_TEXT = "This paragraph has enough words in it to count as the text of a page, and it goes on for a while so that its ratio is high."


@pytest.mark.parametrize(
    "page, want",
    [
        # nothing but blocks: menus and footers by their ratios
        (f'<body><div><a href="/">Home</a> <a href="/x">About us</a></div><div><h2>Title</h2><p>{LONG_TEXT}</p><p>Short.</p><p>{LONG_TEXT}</p></div><div>Copyright me</div></body>', ["Title", LONG_TEXT, "Short.", LONG_TEXT]),
        # the opposite of a mark, marks beside other words, marks on the page's frame
        (f'<div class="layout no-sidebar"><article><p>{LONG_TEXT}</p></article></div>', [LONG_TEXT]),
        (f'<div id="page" class="has-header"><div class="content has-sidebar"><p>{LONG_TEXT}</p><p>End</p></div></div>', [LONG_TEXT, "End"]),
        (f'<article><div class="post-header"><h1>Headline</h1></div><p>{LONG_TEXT}</p><div class="share-price">Shares rose by two percent in the morning.</div></article>', ["Headline", LONG_TEXT, "Shares rose by two percent in the morning."]),
        (f'<form id="page"><div class="sidebar-layout"><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div></form>', [LONG_TEXT, LONG_TEXT]),
        # what is voted against goes, even if it is long
        (f'<div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><div class="comments"><p>{LONG_TEXT}</p></div>', [LONG_TEXT, LONG_TEXT]),
        (f'<article><p>{LONG_TEXT}</p></article><div id="comment-list"><p>{LONG_TEXT} {LONG_TEXT}</p></div>', [LONG_TEXT]),
        (f'<article><p>{LONG_TEXT}<span class="ad">Buy</span></p><aside>{LONG_TEXT}</aside><p>b</p></article>', [LONG_TEXT, "b"]),
        # three articles of falling size are all content
        (f"<article><p>{LONG_TEXT} {LONG_TEXT} {LONG_TEXT}</p></article><article><p>{LONG_TEXT} {LONG_TEXT}</p></article><article><p>{LONG_TEXT}</p></article>", [f"{LONG_TEXT} {LONG_TEXT} {LONG_TEXT}", f"{LONG_TEXT} {LONG_TEXT}", LONG_TEXT]),
        ("<nav>a</nav><footer>b</footer>", []),
    ],
)
def test_regions_of_pages(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def without_roles(page):
    """A page without the tags and classes that tell of roles."""
    return re.sub(r"<(/?)(?:article|nav|footer|aside|header)\b[^>]*>", r"<\1div>", page).replace(' class="ad"', "")


def test_clusters_decide(spark, data, monkeypatch):
    pages = [without_roles(x["html"]) for x in read_table(spark, data, "pages").collect()]
    before = [html_text.main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "clusters", lambda scores, *_: np.ones(len(scores), bool))
    assert sum(html_text.main_text(x) != y for x, y in zip(pages, before, strict=True)) > len(pages) / 2


def test_pages_without_roles(spark, data):
    for x in read_table(spark, data, "pages").collect():
        want, got = html_text.main_text(x["html"]).split("\n\n"), html_text.main_text(without_roles(x["html"])).split("\n\n")
        assert set(want) <= set(got) and len(got) <= len(want) + 2  # at most the footer and the advert


def test_deep_and_broken_pages():
    start = time.perf_counter()
    assert html_text.main_text("<div>" * 50_000 + LONG_TEXT + "</p>" * 50_000 + "</div>" * 50_000 + "<b>" * 20_000 + "</i>" * 20_000) == LONG_TEXT
    assert time.perf_counter() - start < 10


# 4

def components_of(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by = {}
    for i in ids:
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n_base=12, copies=14):
    r = random.Random(seed)
    out = []
    passage = [f"p{i}" for i in range(30)]
    for b in range(n_base):
        base = [f"b{b}w{r.randint(0, 400)}" for _ in range(r.choice([8, 40, 120]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                text[r.randrange(len(text))] = f"e{r.randint(0, 9999)}"
            if r.random() < 0.3:
                text += passage
            out.append(" ".join(text))
    out += [" ".join(passage + [f"u{i}x{j}" for j in range(r.randint(0, 40))]) for i in range(25)]
    out += out[:10]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("tile, narrow, hot", [(256, 64, 1000), (4, 3, 1000), (5, 4, 8)])
def test_ngram_join(spark, tile, narrow, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_HOT", hot)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "NARROW", narrow)
    texts = near_copies(tile) + ODD
    df = docs(spark, texts, n="int", gram="long", component="long")
    got = {tuple(x) for x in ngram_join.similar_documents(df).collect()}
    assert got == components_of(list(enumerate(texts)))
    if tile == 256:
        kept = ngram_join.one_of_each(df)
        assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, _, c in got if i == c}


def test_ngram_join_given_tables(spark, given, empty):
    got = {tuple(x) for x in ngram_join.similar_documents(given).collect()}
    assert got == components_of([(x["doc_id"], x["text"]) for x in given.collect()])
    assert ngram_join.similar_documents(empty).count() == 0
    null_id = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {tuple(x) for x in ngram_join.similar_documents(null_id).collect()} == {(None, 2, None), (1, 2, 1)}


# 5

def test_quality_held_out(spark, data, empty):
    large = data.replace("sf0.001", "sf0.1")
    labels = read_table(spark, large, "labels")
    found = quality.score_quality(read_table(spark, large, "documents"), labels).join(labels, "doc_id").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in found if x["held_out"]]) > 0.97
    odd = quality.score_quality(docs(spark, ODD, score="double"), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    assert odd[0]["score"] == odd[1]["score"]
    assert {x["score"] for x in quality.score_quality(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def features_of(text):
    raw = (text or "").encode()
    words_, size = re.findall(rb"[^\x20\x09-\x0d]+", raw), max(1, len(raw))
    some = max(1, len(words_))
    lines = re.findall(rb"[^\n]+", raw)
    low = lambda x: bytes(b + 32 if 65 <= b <= 90 else b for b in x)
    among = lambda ok: sum(ok(b) for b in raw)
    upper, lower = among(lambda b: 65 <= b <= 90), among(lambda b: 97 <= b <= 122)
    n_lines = max(1, len(lines))
    return [
        np.log1p(len(words_)), sum(map(len, words_)) / some, upper / max(1, upper + lower), among(lambda b: 48 <= b <= 57) / size, raw.count(b"!") / some,
        among(lambda b: chr(b) in "#$%&*+<=>?@[\\]^_`{|}~") / size, among(lambda b: 9 <= b <= 13 or b == 32) / size, len(words_) / n_lines, among(lambda b: b > 127) / size, len({low(w) for w in words_}) / some,
        sum(low(a) == low(b) for a, b in zip(words_, words_[1:], strict=False)) / some, sum(len(w) <= 2 for w in words_) / some, sum(len(w) >= 14 for w in words_) / some, raw.count(b"|") / some, raw.count(b".") / some, len({low(x) for x in lines}) / n_lines, raw.count(b",") / some,
        sum(len(w) > 2 and any(65 <= b <= 90 for b in w[-2:]) for w in words_) / some,
    ]


def test_quality_scores_against_brute_force(spark, given, data):
    labels = read_table(spark, data, "labels")
    texts = [x["text"] for x in given.limit(60).collect()] + [t for t in ODD if t is not LONG] + ["A B\n\nb a| x!, ABC aBC abC", "tie tie tie"]
    df = docs(spark, texts, score="double", label="int")
    joined = given.join(labels, "doc_id")
    model = quality.fit_quality(given.select("doc_id", "text"), labels)
    assert joined.count() > 50
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(given, labels).collect()}
    for x in given.collect():
        f = features_of(x["text"])
        margin = model.base
        for k, table in enumerate(model.tables):
            margin += table[sum(f[k] >= e for e in model.edges[k])]
        rough = [sum(f[k] >= e for e in model.coarse_edges[k]) for k in range(len(f))]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            margin += table[rough[i], rough[j]]
        assert got[x["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
    data_ = [(t or "").encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data_])]).astype(np.int64)
    own = quality.text_features(np.frombuffer(b"".join(data_), np.uint8), at)
    assert own == pytest.approx(np.array([features_of(t) for t in texts]))
    assert len({x["score"] for x in quality.score_quality(df, labels.withColumn("score", F.lit(9))).collect()}) > 1


def test_repeated_labels_and_ids_of_quality(spark, given, data):
    labels = read_table(spark, data, "labels")
    once = {(x["doc_id"], x["score"]) for x in quality.score_quality(given, labels).collect()}
    again = quality.score_quality(given.union(given), labels.union(labels)).collect()
    assert {(x["doc_id"], x["score"]) for x in again} == once and len(again) == 2 * len(once)


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.Additive().fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# 6

def contamination_of(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k : k + n]))
                if x:
                    hit.update(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, given, data, empty):
    bench = read_table(spark, data, "benchmark")
    items = [(x["item_id"], x["text"]) for x in bench.collect()]
    own = spark.createDataFrame([(1, "short item"), (2, None), (3, ""), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (4, "short item"), (None, "x")], "item_id long, text string")
    made = ["a short item b", "W1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", "w2 w3 w4 w5 w6 w7 w8 w9 w10", "short", *ODD]
    for df, b, rows_ in ((given, bench, items), (docs(spark, made), own, [(1, "short item"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (4, "short item")])):
        want = contamination_of([(x["doc_id"], x["text"]) for x in df.collect()], rows_)
        got = {x["doc_id"]: tuple(x)[1:6] for x in decontamination.find_contamination(df, b).collect()}
        assert got == want
        assert b is bench or got == {x["doc_id"]: tuple(x)[1:6] for x in decontamination.find_contamination(df, b, block_bytes=20).collect()}
        kept = decontamination.decontaminate(df, b)
        assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in want.items() if not x[4]}
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert not any(x["contaminated"] for x in decontamination.find_contamination(given, bench.limit(0)).collect())


def test_columns_with_names_of_ours(spark):
    names = ["n_hit", "n_near", "slice", "doc", "terms", "places", "base", "row_key", "spans", "entities", "words", "n_email", "item_id", "block"]
    texts = ["mail ann@corp.example.com twice ann@corp.example.com", "alpha beta gamma delta", None]
    own, plain = docs(spark, texts, **dict.fromkeys(names, "string")), docs(spark, texts)
    bench = spark.createDataFrame([(7, "alpha beta gamma delta", 1)], "item_id long, text string, doc int")
    for run in (pii.find_personal_data, lambda d: decontamination.find_contamination(d, bench), lambda d: decontamination.find_matches(d, bench), license_scan.scan_licenses, ngram_join.similar_documents):
        assert sorted(run(own).collect(), key=repr) == sorted(run(plain).collect(), key=repr)
    for run in (pii.sanitise, lambda d: decontamination.decontaminate(d, bench)):
        assert run(own).columns == own.columns and run(own).drop(*names).collect() == run(plain).collect()


def test_proximity(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    found = decontamination.find_contamination(docs(spark, ["alpha beta x gamma delta", "alpha beta gamma delta", "alpha y"]), bench).orderBy("doc_id").collect()
    assert [(x["n_hit"], x["n_near"]) for x in found] == [(0, 1), (4, 0), (0, 0)]


def matches_of(texts, items, size=10, slop=3):
    count = Counter(w for _, t in texts for w in words_of(t))
    exact, near = set(), set()
    for i, t in items:
        item = words_of(t)
        n = min(size, len(item))
        for k in range(len(item) - n + 1 if item else 0):
            own = item[k : k + n]
            rare = sorted(range(n), key=lambda j: count[own[j]])[:3]
            for d, text in texts:
                w = words_of(text)
                for p in [p for p in range(len(w)) if w[p] == own[rare[0]]]:
                    at = p - rare[0]
                    if at >= 0 and w[at : at + n] == own:
                        exact.add((d, str(i), "exact", k, at, n))
                    if all(own[j] in w[max(0, at + j - slop) : max(0, at + j + slop + 1)] for j in rare[1:]):
                        near.add((d, str(i), "near", k, at, n))
    return exact | {x for x in near if x[:2] not in {y[:2] for y in exact}}


def test_places_of_matches(spark, data, monkeypatch):
    items = [(7, "alpha beta gamma delta"), (8, " ".join(f"k{i}" for i in range(25))), (9, "a b")]
    broken = " ".join("other" if i % 8 == 4 else f"k{i}" for i in range(25))
    texts = list(enumerate(["alpha beta x gamma delta", "z alpha beta gamma delta alpha", f"so {broken} on", "beta gamma delta", "a b a c b", None, "", "k4 k4 k12 k12 k20 k20"]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = matches_of(texts, items)
    assert {x[:3] for x in want} >= {(0, "7", "near"), (1, "7", "exact"), (2, "8", "near"), (4, "9", "exact")} and (2, "8", "exact") not in {x[:3] for x in want}
    df = docs(spark, [t for _, t in texts])
    for size, places in ((20, 3), (decontamination.BLOCK_BYTES, decontamination.PLACES)):
        monkeypatch.setattr(decontamination, "PLACES", places)
        got = [tuple(x) for x in decontamination.find_matches(df, bench, block_bytes=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    report = {x["doc_id"]: x for x in decontamination.find_contamination(df, bench).collect()}
    for d, _ in texts:
        assert [len({x[1] for x in want if x[0] == d and x[2] == kind}) for kind in ("exact", "near")] == [report[d]["n_items"], report[d]["n_near"]]
    counts = QUERIES["op6_decontamination"](spark, data).select("doc_id", "n_items").where("n_items > 0").collect()
    exact = QUERIES["op6_matches"](spark, data).where("kind = 'exact'").groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items")).collect()
    assert {tuple(x) for x in exact} == {tuple(x) for x in counts}


# 7

def test_licences(spark, given, empty):
    made = ["Released under the MIT License. Licensed under the Apache License, Version 2.0.", "GNU General Public License", *ODD]
    for df in (docs(spark, made, labels="string"), given):
        got = {x["doc_id"]: x for x in license_scan.scan_licenses(df).collect()}
        for x in df.collect():
            w, hits = words_of(x["text"]), []
            for label, phrase in license_scan.BASE:
                p = phrase.split()
                hits += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
            g, own = got[x["doc_id"]], sorted({h[1] for h in hits})
            assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(own))
            assert set(own) <= set(g["labels"].split(",")) or not own
            assert 0 <= g["score"] <= 1
    changed = "permission is hereby granted, free of charge, to any human obtaining one copy of this software and associated documents, to deal in it without restriction including without limitation the right to use it"
    part = license_scan.scan_licenses(docs(spark, [changed, changed + " " + changed])).orderBy("doc_id").collect()
    assert [x["labels"] for x in part] == ["mit", "mit"] and 0.2 < part[0]["score"] <= part[1]["score"] < 0.9
    first = license_scan.scan_licenses(docs(spark, made)).where("doc_id = 0").first()
    assert first["labels"] == "apache,apache-2.0,mit" and first["score"] == 1.0
    assert license_scan.scan_licenses(empty).count() == 0


def test_licences_of_many_notices(spark):
    notices = {label: text for label, text, _ in license_scan.TEMPLATES}
    made = [" filler text ".join(x[1] for x in license_scan.TEMPLATES), *[" . ".join(notices[x] for x in own) for own in (("bsd", "mpl-2.0", "isc"), ("gpl", "bsd", "mpl-2.0"), ("gpl-3.0", "bsd", "mpl-2.0", "unlicense"))]]
    got = license_scan.scan_licenses(docs(spark, made)).orderBy("doc_id").collect()
    assert set(got[0]["labels"].split(",")) == {*notices, "apache"}
    assert got[0]["n_templates"] == len(notices) and got[0]["score"] == 1.0
    assert [x["labels"] for x in got[1:]] == ["bsd,isc,mpl-2.0", "bsd,gpl,mpl-2.0", "bsd,gpl,gpl-3.0,mpl-2.0,unlicense"]
    assert all(x["score"] == 1.0 for x in got)


# 8

def test_neighbours(spark):
    r = np.random.default_rng(0)
    rows_ = [(i, r.normal(size=8).tolist()) for i in range(400)]
    rows_ += [(400, None), (401, [0.0] * 8), (402, [1.0] + [None] * 7), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, []), (406, [1.0, 2.0]), (407, rows_[50][1]), (407, rows_[50][1]), (408, rows_[50][1]), (None, rows_[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows_], "vec_id long, embedding array<double>, score string")
    ok = {i: np.array(v) for i, v in rows_ if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for q in [i for i in ok if i % 50 == 0]:
        near = sorted(((-float(ok[q] @ ok[c] / np.sqrt((ok[q] @ ok[q]) * (ok[c] @ ok[c]))).__round__(9), c) for c in ok if c != q))[:5]
        want |= {(q, k, c) for k, (_, c) in enumerate(near, 1)}
    for tile, block in ((8192, 2048), (64, 3)):
        got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), tile=tile, block=block)
        assert {(x["query_id"], x["rank"], x["vec_id"]) for x in got.collect()} == want
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2
    # many copies of one vector: the smallest ids
    same = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 2.0).otherwise(F.col("id") + 5.0)).alias("embedding"))
    got = neighbours.nearest(same, same.where("vec_id % 50 = 0"), tile=32, block=2).where("query_id = 150").orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == [0, 3, 6, 9, 12]
    # a group of near copies that codes do not tell apart
    x = r.normal(size=8)
    close = [(i, (x + 1e-6 * r.normal(size=8)).tolist() if i < 500 else r.normal(size=8).tolist()) for i in range(600)]
    near = spark.createDataFrame(close, "vec_id long, embedding array<double>")
    every = {i: np.array(v) for i, v in close}
    for t in (8192, 128):
        for x in neighbours.nearest(near, near.where("vec_id % 50 = 0"), tile=t).where("query_id in (100, 550)").collect():
            q = every[x["query_id"]]
            best = sorted(((-float(q @ v / np.sqrt((q @ q) * (v @ v))), i) for i, v in every.items() if i != x["query_id"]))[:5]
            assert x["score"] == pytest.approx(-best[x["rank"] - 1][0], abs=1e-15)
    # tiny and huge vectors, an id that repeats with another length
    odd = spark.createDataFrame([(0, [1e-200, 2e-200]), (1, [3e-200, 6e-200]), (2, [1e200, -1e200]), (3, [2.0, 4.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(x["vec_id"], round(x["score"], 9)) for x in neighbours.nearest(odd, odd.where("vec_id = 0")).collect()}
    assert got == {(1, 1.0), (3, 1.0), (2, round(-1 / np.sqrt(10), 9))}


# 9

ADD = {"add": {"x": {"type": "BIGINT", "least": 0, "most": 100}, "y": {"type": "BIGINT"}}}


def test_tool_calls(spark):
    calls = '{"tool_calls":[{"id":"a","name":"add","arguments":{"y":1,"x":2}},{"id":"b","name":"add","arguments":{"x":"2"},"depends_on":["a"]},{"id":"c","name":"add","arguments":{"x":1,"y":1},"depends_on":["b"]},{"id":"d","name":"none","arguments":{},"depends_on":["e"]},{"id":"e","name":"add","arguments":{"x":1,"y":2},"depends_on":["d"]}]}'
    rows_ = [(1, 0, "user", "hi"), (1, 1, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 3, "tool", '{"tool_call_id":"q","content":"4"}'), (None, 0, None, None)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1))
    got = {(x["kind"], x["conv_id"], x["call_id"], x["turn"]): x for x in chat.format_chat(df, ADD, turns_as_calls=False).collect()}
    assert {k[2]: (v["depth"], v["valid"], v["n_results"]) for k, v in got.items() if k[0] == "call"} == {"a": (0, True, 1), "b": (1, False, 0), "c": (2, True, 0), "d": (None, False, 0), "e": (None, False, 0)}
    assert got["call", 1, "a", 1]["json"] == '{"arguments":{"x":2,"y":1},"id":"a","name":"add","result":"3"}'
    assert sorted((k[1] or 0, k[3]) for k in got if k[0] == "message") == [(0, 0), (1, 0), (1, 3)]
    assert got["message", None, None, 0]["json"] == '{"role":null,"text":""}'
    assert chat.format_chat(df.limit(0)).count() == 0


def test_arguments_against_schemas(spark):
    given = {"a": '{"x":100,"y":-1}', "b": '{"x":101,"y":1}', "c": '{"x":1,"y":1,"z":1}', "d": '{"x":1}', "e": "[1]", "f": '{"x":1.5,"y":1}', "g": '{"x":null,"y":1}'}
    text = '{"tool_calls":[' + ",".join(f'{{"id":"{k}","name":"add","arguments":{v}}}' for k, v in given.items()) + ',{"id":"h","name":null},{"id":null,"name":"add"}]}'
    df = spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = {x["call_id"]: x for x in chat.format_chat(df, ADD, turns_as_calls=False).collect()}
    assert {k for k, x in got.items() if x["valid"]} == {"a"} and set(got) == {*given, "h"}
    assert got["h"]["json"] == '{"arguments":null,"id":"h","name":null}'


def test_depths_against_brute_force(spark):
    r = random.Random(4)
    needs = {}
    for c in range(6):
        ids = [f"k{i}" for i in range(40)]
        for i, x in enumerate(ids):
            free = ids[:i] if c < 4 else ids  # the last conversations have circles
            needs[c, x] = sorted(set(r.sample(free, min(len(free), r.choice([0, 1, 1, 1, 1, 2, 3]))))) if r.random() < 0.95 else ["no such call"]
    for i in range(300):
        needs[9, f"k{i}"] = [f"k{i - 1}"] if i else []
    want = {k: 0 for k, v in needs.items() if not v}
    while True:
        more = {k: 1 + max(want[k[0], x] for x in v) for k, v in needs.items() if k not in want and all((k[0], x) in want for x in v)}
        if not more:
            break
        want |= more
    df = spark.createDataFrame([(c, k, v) for (c, k), v in needs.items()] + [(9, "k5", ["k4"])], "conv_id long, call_id string, needs array<string>")
    got = {(x["conv_id"], x["call_id"]): x["depth"] for x in chat.depths(df).collect()}
    assert got == {k: want.get(k) for k, v in needs.items() if v} and got[9, "k299"] == 299 and None in got.values()


def test_dialogues_as_calls(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)
    long = "long text " * 30_000
    rows_ = [(1, t, ("user", "assistant")[t % 2], f"turn number {t} of some length") for t in range(20)]
    rows_ += [(1, 1, "assistant", "b"), (2, 0, "user", long), (2, 1, "assistant", long), (2, 6, "user", None), (3, 5, "assistant", "alone"), (3, 6, "user", "twice, the same row"), (3, 6, "user", "twice, the same row"), (1, None, "user", "x"), (4, 0, "system", "s")]
    df = spark.createDataFrame([(*x, "own") for x in rows_], "conv_id long, turn long, role string, text string, call_id string")
    got = chat.format_chat(df).collect()
    calls = sorted((x["conv_id"], x["turn"], x["depth"], x["valid"], x["n_results"]) for x in got if x["kind"] == "call")
    assert calls == [*((1, t, t // 2, True, 2 if t == 0 else 1) for t in range(0, 20, 2)), (2, 0, 0, False, 1), (2, 6, 1, False, 0), (3, 6, 0, True, 0), (3, 6, 0, True, 0)]
    assert sorted(x["json"] for x in got if x["kind"] == "result") == ['{"content":"b","id":"1:0"}', '{"content":"turn number 1 of some length","id":"1:0"}']
    assert sorted(x["json"] for x in got if x["kind"] == "message") == ['{"role":"assistant","text":"alone"}', '{"role":"system","text":"s"}', '{"role":"user","text":"x"}']
    assert next(x["json"] for x in got if x["kind"] == "call" and x["conv_id"] == 2 and x["turn"] == 0) == f'{{"arguments":{{"text":"{long}"}},"id":"2:0","name":"reply","result":"{long}"}}'


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(connect(data).sql(ORACLES[name]).df())


# 10

def test_encoding_equals_the_library(spark, given, empty):
    import sentencepiece

    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    made = ["".join(r.choice(a) for _ in range(r.randint(1, 50))) for a in (["ab ", "the in", ".=-_ \n", "éèab▁ ", "0123 ", "aA😀\n\t "] * 60)]
    texts = ["<s>", "<0x0A>", "▁▁x", "a" * 300, " " * 70, "\n\n a\n", *made, *ODD]
    for df in (docs(spark, texts, ids="string"), given):
        got = {x["doc_id"]: tuple(x)[1:] for x in sentencepiece_codec.encode_documents(df, path).collect()}
        for x in df.collect():
            ids = library.encode(x["text"] or "")
            want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
            assert got[x["doc_id"]] == want
    assert sentencepiece_codec.encode_documents(empty, path).count() == 0
    own = sentencepiece_codec.token_ids(docs(spark, ["a b", None]), path).orderBy("doc_id").collect()
    assert [x["token_ids"] for x in own] == [library.encode("a b"), []]
    with pytest.raises(ValueError):
        sentencepiece_codec.token_ids(docs(spark, ["a"], token_ids="int"), path)


def test_long_unbroken_runs():
    import sentencepiece

    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_codec.codec(path).model
    r = random.Random(9)
    base64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(80_000))
    for text in (base64, "the" * 20_000, "".join(r.choice("etaoin") for _ in range(20_000)), "-=" * 30_000):
        start = time.perf_counter()
        assert model.encode_segments([sentencepiece_codec.SPACE + text])[0] == library.encode(text)
        assert text is not base64 or time.perf_counter() - start < 1.0


def test_decoding_of_any_ids():
    import sentencepiece

    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_codec.codec(path).model
    r = random.Random(3)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(1, 12))]
        assert model.decode(ids) == library.decode(ids)
