"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The words
of a document, wherever they stand outside its base spans, are then held against the
corpus: with p counted in whole documents, a word discloses a value when the pointwise
mutual information of both comes within a factor ``alpha`` of the value's own information,

    log2(p(value, word) / (p(value) p(word))) >= -log2 p(value) / alpha,

with at least ``support`` documents that have both. Such a word is a span too, of kind
``term``, at all its places in all documents, with the value in them or without.
Sanitising puts the kind in place of each span.

Values and words with them come from the documents with base spans alone; the document
counts of candidate words are taken over all documents. Values in fewer than ``support``
documents, and words too frequent for the value, cannot reach the threshold and are left
out before pairs are counted. Values that stand in the same documents form one class, and
so do words with the same documents and count, as their information is the same: pairs are
those of classes, and copies of a document with very many values and words make few. A
value or word that very many documents share is aggregated before any shuffle, and words
that are too frequent for every value leave the pairs without one.

Places are running sums of lengths. They, and cuts of long texts, work block by block, so
that a text with n spans costs little more than n steps.

Defined results: null and empty texts have no spans; repeated rows are counted as
documents of their own and get equal spans; a span that begins inside an earlier one is
replaced with that one; of spans that begin together the kind listed first is named; an empty table gives no rows; columns other
than id and text are ignored by ``find_personal_data`` and kept by ``sanitise``; texts
are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ["email", "ip", "card", "phone"]
# Possessive forms of the base patterns. A run can only begin where the last match ended
# or where the character before is no part of it, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A quick test that texts without a match fail.
_HINT = {"email": "@", "phone": "+", "ip": "."}
_WORD = r"[\p{L}\p{M}\p{N}]++"
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: Rows and spans that are broadcast at most; beyond that a shuffled join takes over.
SMALL_ROWS = 500_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, 1).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step, start: int = 0) -> Column:
    """For each entry of an integer array the fold of the entries before it, and last the
    fold of all. Blocks of about the root of their number keep what is copied small."""
    first = F.array(F.lit(start)).cast("array<int>")
    on = lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))

    def of(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        last = F.floor((F.size(v) - 1) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda b: F.aggregate(b, F.lit(start), step))
            bases = F.aggregate(totals, first, on)
            inside = F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda b, base: F.slice(F.aggregate(b, F.array(base).cast("array<int>"), on), 1, F.size(b)))
            return F.concat(F.flatten(inside), F.slice(bases, -1, 1))

        return let(blocks, joined)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(first)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """(start, stop, value) of all matches in code points: the pieces between them and
    their own lengths add up to their places."""

    def of(found: Column) -> Column:
        # (gap before, length, value) of each; the piece after the last match is left out
        parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size"), m.alias("value")))

        def placed(x: Column) -> Column:
            ends = F.slice(running(F.transform(x, lambda y: y["gap"] + y["size"]), _sum), 2, F.size(x))
            return F.zip_with(x, ends, lambda y, end: F.struct((end - y["size"]).alias("start"), end.alias("stop"), y["value"].alias("value")))

        return let(parts, placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


#: Code points of a block that texts are cut from.
_BLOCK = 512


class Cuts:
    """Pieces of a text between two places, from blocks of it: a cut costs no more than
    its length and a block."""

    def __init__(self, blocks: Column):
        self.blocks = blocks

    @staticmethod
    def of(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def piece(self, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _BLOCK).cast("int"), F.floor((b - 1) / _BLOCK).cast("int")
        at = lambda k: F.element_at(self.blocks, k + 1)
        inside = F.substring(at(first), a % _BLOCK + 1, b - a)
        across = F.concat(F.substring(at(first), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(self.blocks, first + 2, last - first - 1), ""), F.substring(at(last), F.lit(1), b - last * _BLOCK))
        return F.when(b <= a, "").when(first == last, inside).otherwise(across)


def rebuilt(text: Column, spans: Column, put) -> Column:
    """The text with ``put(span, from)`` for what each span covers beyond those before it,
    where ``from`` is the first place not covered yet; spans are in order of start."""

    def of(s: Column) -> Column:
        cuts, own, seen = Cuts(s["blocks"]), s["spans"], s["seen"]
        parts = F.zip_with(own, F.slice(seen, 1, F.size(own)), lambda x, at: F.concat(cuts.piece(at, x["start"]), put(x, at)))
        return F.concat(F.array_join(parts, ""), cuts.piece(F.element_at(seen, -1), s["size"]))

    seen = running(F.transform(spans, lambda x: x["stop"]), lambda a, b: F.greatest(a, b))
    state = F.struct(Cuts.of(text).alias("blocks"), spans.alias("spans"), seen.alias("seen"), F.char_length(text).alias("size"))
    return F.when(F.size(spans) > 0, let(state, of)).otherwise(text)


def _of_kind(found: Column, number: int, kind: str) -> Column:
    valid = F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All valid base spans by start, then kind."""
    parts = []
    for i, kind in enumerate(KINDS):
        some = text.rlike(PATTERNS[kind])
        if kind in _HINT:
            some = F.contains(text, F.lit(_HINT[kind])) & some
        of_kind = _of_kind(matches(text, PATTERNS[kind]), i, kind)
        parts.append(F.when(some, of_kind).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*parts))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, all other places as they were."""
    return rebuilt(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["stop"] - F.greatest(x["start"], at), F.lit(0))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _places(text: Column, words: Column) -> Column:
    """Spans of kind ``term`` wherever one of the words stands. A word is looked for among
    those of its hash, in about as many lists as the root of their number."""

    def of(s: Column) -> Column:
        lists = lambda w: F.pmod(F.xxhash64(w), s["width"])
        parts = F.transform(F.sequence(F.lit(0), s["width"] - 1), lambda b: F.filter(s["words"], lambda w: lists(w) == b))

        def among(state: Column) -> Column:
            placed = F.transform(state["found"], lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lower(x["value"]).alias("word")))
            hits = F.filter(placed, lambda x: F.array_contains(F.element_at(state["parts"], (lists(x["word"]) + 1).cast("int")), x["word"]))
            return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["stop"].alias("stop"), F.lit("").alias("value")))

        return let(F.struct(parts.alias("parts"), s["found"].alias("found")), among)

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(words)))).cast("int")
    return let(F.struct(words.alias("words"), width.alias("width"), matches(text, _WORD).alias("found")), of)


def _entity(span: Column) -> Column:
    return F.when(span["kind"] >= 2, F.concat(span["kind"].cast("string"), F.lit(":"), _digits(span["value"]))).otherwise(F.concat(span["kind"].cast("string"), F.lit(":"), F.lower(span["value"])))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))))


def _row_key(doc_id: str, text: str) -> Column:
    """128 bits of the id and the text: equal for repeated rows alone."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _class_of(row: Column) -> list[Column]:
    """Sums that are equal for equal sets of rows (128 bits of hashes; no sum of up to
    2^31 rows overflows). They need no order and are added up before any shuffle."""
    parts = []
    for seed in (0, 1):
        h = F.xxhash64(row, F.lit(seed))
        parts += [F.sum(F.shiftrightunsigned(h, 32)).alias(f"high{seed}"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low{seed}")]
    return parts


def _class_key(*more: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("high0", "low0", "high1", "low1", *more)])))


def analyse(docs: DataFrame, alpha: float = 1.25, support: int = 2, doc_id: str = "doc_id", doc_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (row_key, doc_id, base spans) and the disclosing words' spans (row_key, terms)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"), _row_key(doc_id, doc_text).alias("row_key"))
    found = texts.select("doc_id", "row_key", "text", base_spans(F.col("text")).alias("base"))
    # a row is a document, and repeated rows are documents of their own: its number is written with it
    rows = stash(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "row_key", "base", F.array_distinct(F.transform("base", _entity)).alias("entities"), _words(_blanked(F.col("text"), F.col("base"))).alias("words")))
    base_rows = rows.where(F.size("base") > 0)
    total = float(max(1, rows.count()))
    counted = base_rows.select("row", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"), *_class_of(F.col("row")))
    values = stash(counted.where((F.col("with_entity") >= support) & (F.col("with_entity") < total)).select("entity", "with_entity", _class_key().alias("value_class")))
    most = values.agg(F.max("with_entity")).first()[0] or 0
    # both <= with_entity, so the threshold bounds with_word; a little wider than that
    bound = F.pow(F.lit(total), F.lit(1 - 1 / alpha)) * F.pow(F.col("with_entity").cast("double"), F.lit(1 / alpha)) * (1 + 1e-6)
    row_values = base_rows.select("row", F.explode("entities").alias("entity")).join(_small(values), "entity").groupBy("row").agg(F.collect_set(F.struct("value_class", "with_entity", bound.alias("bound"))).alias("held_values"))
    row_values = stash(row_values)
    held = base_rows.select("row", "words").join(_small(row_values.select("row")), "row", "left_semi").select("row", F.explode("words").alias("word"))
    # a word in fewer rows with values cannot share enough of them with one
    words = stash(held.groupBy("word").agg(F.count("*").alias("with_values"), *_class_of(F.col("row"))).where(F.col("with_values") >= support))
    # one row for each word before the words of values are looked up
    each = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("with_word")).join(_small(words), "word")
    highest = total ** (1 - 1 / alpha) * most ** (1 / alpha) * (1 + 1e-6)
    each = stash(each.select("word", "with_word", _class_key("with_word").alias("word_class")))
    candidates = each.where(F.col("with_word") <= highest)
    # words of a thousandth of all rows that are too frequent for every value: no more than
    # a thousand times the mean number of words in a row
    frequent = each.where((F.col("with_word") > highest) & (F.col("with_word") >= total / 1000)).select("word")
    if frequent.count() <= SMALL_ROWS:
        held = held.join(F.broadcast(frequent), "word", "left_anti")
    row_words = held.join(_small(candidates), "word").groupBy("row").agg(F.collect_set(F.struct("word_class", "with_word")).alias("held_words"))
    pairs = row_words.join(row_values, "row").select("held_words", F.explode("held_values").alias("v")).select("v.*", F.explode("held_words").alias("w")).select("value_class", "with_entity", "bound", "w.*")
    pairs = pairs.where(F.col("with_word") <= F.col("bound"))
    scored = pairs.groupBy("value_class", "word_class", "with_entity", "with_word").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    information = F.log2(F.lit(total) / F.col("with_entity"))
    mutual = F.log2(F.col("both") * total / (F.col("with_entity") * F.col("with_word")))
    classes = stash(scored.where(mutual >= information / alpha).select("word_class").distinct())
    disclosing = stash(candidates.join(_small(classes), "word_class", "left_semi").select("word"))
    marks = rows.select("row_key", F.explode("words").alias("word")).join(_small(disclosing), "word").groupBy("row_key").agg(F.collect_set("word").alias("marks"))
    marked = texts.join(_small(stash(marks)), "row_key").dropDuplicates(["row_key"]).select("row_key", "marks", "text", base_spans(F.col("text")).alias("base"))
    return rows.select("doc_id", "row_key", "base"), marked.select("row_key", _places(_blanked(F.col("text"), F.col("base")), F.col("marks")).alias("terms"))


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    terms = stash(terms)
    held = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("spans")).first()
    small = held["n"] <= SMALL_ROWS and held["spans"] <= SMALL_ROWS
    return rows.join(F.broadcast(terms) if small else terms, "row_key", "left")


def _is(number: int):
    return lambda x: x["kind"] == number


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for each row."""
    rows, terms = analyse(docs, **options)
    all_rows = _with_terms(rows.select("doc_id", "row_key", "base"), terms).withColumn("terms", F.coalesce("terms", F.array().cast(_SPAN)))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_sort(F.concat("base", "terms"))
    return all_rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The documents with the kind in place of each span; ``n_chars`` follows the text."""
    _, terms = analyse(docs, doc_id=doc_id, doc_text=doc_text, **options)
    # the row as one struct, so that no column of it can clash with those added here
    packed = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"), _row_key(doc_id, doc_text).alias("row_key"))
    marked = _with_terms(packed.withColumn("base", base_spans(F.col("text"))), terms)
    marked = marked.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN)))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in [*KINDS, "term"]])
    done = rebuilt(F.col("text"), F.col("spans"), lambda x, at: F.when(x["start"] >= at, F.element_at(names, x["kind"] + 1)).otherwise(""))
    new = marked.withColumn("done", F.when(F.size("spans") > 0, done))

    def column(c: str) -> Column:
        old = F.col("doc")[c]
        if c == doc_text:
            return F.coalesce("done", old).alias(c)
        if c == n_chars:
            return F.coalesce(F.char_length("done").cast(docs.schema[c].dataType), old).alias(c)
        return old.alias(c)

    return new.select(*[column(c) for c in docs.columns])
