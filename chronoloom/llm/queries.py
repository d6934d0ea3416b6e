"""The text operators as queries over the given tables, and their SQL where there is one.

A query here is thin: it reads whole tables, applies its operator with production
parameters and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html_text, license_scan, neighbours, ngram_join, pii, quality, sentencepiece_codec, simhash, spelling, toxicity, whitening
from .common import read_table


def tokenizer_path() -> str:
    """The vocabulary file where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.format_chat(read_table(spark, sf_dir, "conversations"))
    return lines.select("conv_id", "turn", "kind", "call_id", "depth", "n_results", "valid", F.char_length("json").cast("long").alias("n_json"), F.sha2("json", 256).alias("json_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op6_matches": op6_matches,
    "op7_licenses": op7_licenses,
    "op8_neighbours": op8_neighbours,
    "op9_chat": op9_chat,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"

_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) ELSE 2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) - CASE WHEN CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


def _found(rows: str, kind: int, pattern: str) -> str:
    """Matches in order with the text before each."""
    return f"SELECT doc_id, {kind} AS k, i, ms[i] AS v, length(gs[i]) AS gap FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM {rows}))"


_PLACED = "SELECT doc_id, k, v, (sum(gap + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(v))::BIGINT AS a, (sum(gap + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS b FROM"
_BASE = " UNION ALL ".join(_found("d", k, p) for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"]))



def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _license_sql() -> str:
    """Votes of rare template words by diagonal, key phrases near their places, shares."""
    notices = [license_scan.words_of(x[1]) for x in license_scan.TEMPLATES]
    terms = [(t, j, w) for t, own in enumerate(notices) for j, w in enumerate(own)]
    sizes = [(t, x[0], len(own), max(4, round(0.5 * len(set(own))))) for t, (x, own) in enumerate(zip(license_scan.TEMPLATES, notices, strict=True))]
    phrases = [(t, license_scan.words_of(k)) for t, x in enumerate(license_scan.TEMPLATES) for k in x[2]]
    keys = [(k, t, next(j for j in range(len(notices[t])) if notices[t][j : j + len(p)] == p), len(p), " ".join(p)) for k, (t, p) in enumerate(phrases)]
    base = [(label, len(p.split()), p) for label, p in license_scan.BASE]
    lengths = ", ".join(str(n) for n in sorted({k[3] for k in keys} | {b[1] for b in base}))
    return f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents), tk AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
        te AS (SELECT * FROM {_values(terms)} v(t, j, w)), si AS (SELECT * FROM {_values(sizes)} v(t, label, n, rare)), ke AS (SELECT * FROM {_values(keys)} v(k, t, j, n, phrase)), bp AS (SELECT * FROM {_values(base)} v(label, n, phrase)),
        tc AS (SELECT w, count(*) AS c FROM tk WHERE w IN (SELECT w FROM te) GROUP BY w),
        rk AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY coalesce(c, 0) = 0, c, w) AS r FROM (SELECT DISTINCT t, w FROM te) LEFT JOIN tc USING (w)),
        po AS (SELECT te.t, te.j, te.w FROM te JOIN rk ON rk.t = te.t AND rk.w = te.w JOIN si ON si.t = te.t WHERE r <= rare),
        vo AS (SELECT doc_id, t, p - j AS g FROM tk JOIN po USING (w) GROUP BY doc_id, t, g HAVING count(*) >= 2),
        gr AS (SELECT doc_id, i AS p, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, (SELECT unnest([{lengths}]) AS n) WHERE len(ws) >= n)),
        kp AS (SELECT k, t, j, doc_id, p FROM gr JOIN ke USING (n, phrase)), kn AS (SELECT t, count(*) AS n FROM ke GROUP BY t),
        fo AS (SELECT vo.doc_id, vo.t, g FROM vo JOIN kp ON kp.doc_id = vo.doc_id AND kp.t = vo.t AND abs(p - g - kp.j) <= 10 GROUP BY vo.doc_id, vo.t, g HAVING count(DISTINCT k) = (SELECT n FROM kn WHERE kn.t = vo.t)),
        sh AS (SELECT fo.doc_id, label, count(tk.w) / si.n::DOUBLE AS share FROM fo JOIN si USING (t) JOIN te ON te.t = fo.t LEFT JOIN tk ON tk.doc_id = fo.doc_id AND tk.p = g + te.j AND tk.w = te.w GROUP BY fo.doc_id, fo.t, g, label, si.n),
        fl AS (SELECT doc_id, label, max(share) AS share FROM sh GROUP BY ALL), ba AS (SELECT doc_id, label, p FROM gr JOIN bp USING (n, phrase)),
        bs AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM ba GROUP BY doc_id),
        bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM ba) GROUP BY doc_id),
        ll AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM ba UNION SELECT doc_id, label FROM fl) GROUP BY doc_id),
        fs AS (SELECT doc_id, max(share) AS share, count(*) AS n_templates FROM fl GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score, coalesce(n_templates, 0) AS n_templates
        FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN bl ON bl.doc_id = d.doc_id LEFT JOIN ll ON ll.doc_id = d.doc_id LEFT JOIN fs ON fs.doc_id = d.doc_id"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _spelling_sql() -> str:
    """Words by crc32 over UTF-8 bytes, near words by what is left without a code point."""
    low = "translate(doc_id || ':' || r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    code = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"""
        WITH RECURSIVE ta AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS t),
        ru AS (SELECT {low} AS s, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) WHERE length(r) >= 5 GROUP BY s),
        cr AS (SELECT string_split(s, ':')[2] AS w, k, xor(list_reduce({code}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM ru, ta),
        de AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM cr),
        wo AS (SELECT word, sum(k)::BIGINT AS n FROM de WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        si AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS g FROM (SELECT word, n, unnest(range(length(word))) AS i FROM wo)),
        pa AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM si a JOIN si b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
               UNION SELECT wo.word, si.word, si.n FROM wo JOIN si ON si.g = wo.word UNION SELECT si.word, wo.word, wo.n FROM wo JOIN si ON si.g = wo.word),
        be AS (SELECT x, count(*) AS n_near, max(m) AS top FROM pa GROUP BY x),
        bw AS (SELECT be.x, n_near, top, min(y) AS best FROM be JOIN pa ON pa.x = be.x AND m = top GROUP BY ALL),
        fo AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN best END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM wo LEFT JOIN bw ON x = word),
        ro AS (SELECT word, word AS reached, 0 AS k FROM fo UNION ALL SELECT ro.word, form, k + 1 FROM ro JOIN fo ON fo.word = reached WHERE form IS NOT NULL)
        SELECT fo.word, n, form, form_n, root, n_near FROM fo JOIN (SELECT word, max_by(reached, k) AS root FROM ro GROUP BY word) r ON r.word = fo.word"""


ORACLES: dict[str, str] = {
    "op13_spelling": _spelling_sql(),
    "op7_licenses": _license_sql(),
    "op1_pii": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), tot AS (SELECT count(*)::DOUBLE AS n FROM d),
        al AS ({_PLACED} ({_BASE})), ch AS (SELECT *, {_DIGITS} AS d FROM al),
        ba AS (SELECT doc_id, k, a, b, CASE WHEN k >= 2 THEN d ELSE lower(v) END AS val FROM ch WHERE k = 0 OR (k = 1 AND regexp_full_match(v, '{_PART}\.{_PART}\.{_PART}\.{_PART}'))
               OR (k = 2 AND length(d) BETWEEN 14 AND 19 AND {_LUHN}) OR (k = 3 AND length(d) BETWEEN 10 AND 15)),
        co AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS p FROM ba),
        cs AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM ba)),
        bl AS (SELECT cs.doc_id, string_agg(CASE WHEN co.p IS NULL THEN c ELSE ' ' END, '' ORDER BY cs.p) AS t FROM cs LEFT JOIN co ON co.doc_id = cs.doc_id AND co.p = cs.p GROUP BY cs.doc_id),
        pl AS (SELECT d.doc_id, coalesce(bl.t, d.t) AS t FROM d LEFT JOIN bl ON bl.doc_id = d.doc_id),
        ws AS ({_PLACED} ({_found("pl", 4, r"[\p{L}\p{M}\p{N}]+")})), dw AS (SELECT DISTINCT doc_id, lower(v) AS w FROM ws),
        en AS (SELECT DISTINCT doc_id, k || ':' || val AS e FROM ba), ec AS (SELECT e, count(*) AS ne FROM en, tot GROUP BY e, n HAVING count(*) >= 2 AND count(*) < n),
        wc AS (SELECT w, count(*) AS nw FROM dw GROUP BY w), bo AS (SELECT e, w, count(*) AS nb FROM en JOIN ec USING (e) JOIN dw USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
        di AS (SELECT DISTINCT w FROM bo JOIN ec USING (e) JOIN wc USING (w), tot WHERE log2(nb * n / (ne * nw)) >= log2(n / ne) / 1.25),
        sp AS (SELECT doc_id, k, a, b FROM ba UNION ALL SELECT doc_id, k, a, b FROM ws WHERE lower(v) IN (SELECT w FROM di)),
        nm AS (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || a || ':' || b AS s FROM sp),
        ag AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{x}" for i, x in enumerate(["email", "ip", "card", "phone", "term"]))},
               string_agg(s, ',' ORDER BY a, k, b) FILTER (k < 4) AS base, string_agg(s, ',' ORDER BY a, k, b) AS spans FROM nm GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in ["email", "ip", "card", "phone", "term"])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN ag ON ag.doc_id = d.doc_id""",
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN list_slice(ws, i, i + 4) ELSE ws END AS g
               FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
        pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        ln AS (SELECT x, y FROM pr JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        re AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT re.x, ln.y FROM re JOIN ln ON re.y = ln.x)
        SELECT re.x AS doc_id, coalesce(max(sz.n), 0) AS n_shingles, min(re.y) AS component_id FROM re LEFT JOIN sz ON sz.doc_id = re.x GROUP BY re.x""",
    "op6_decontamination": f"""
        WITH w AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
        b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT row_number() OVER () AS win, item, n, list_slice(ws, i, i + n - 1) AS g FROM (
            SELECT CAST(item_id AS VARCHAR) AS item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
        bd AS (SELECT DISTINCT item, n, g FROM bw),
        dw AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS g FROM (
            SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bd) WHERE len(ws) >= n)),
        hit AS (SELECT doc_id, dw.i, dw.n, item FROM dw JOIN bd ON dw.n = bd.n AND dw.g = bd.g),
        hc AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY ALL),
        ex AS (SELECT DISTINCT doc_id, item FROM hit),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM ex GROUP BY ALL),
        tk AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS p FROM w),
        te AS (SELECT win, item, n, unnest(g) AS t, unnest(range(n)) AS j FROM bw),
        tc AS (SELECT t, count(*) AS c FROM tk GROUP BY ALL),
        rk AS (SELECT win, item, n, t, j, row_number() OVER (PARTITION BY win ORDER BY coalesce(c, 0), j) AS r FROM te LEFT JOIN tc USING (t)),
        ra AS (SELECT win, any_value(item) AS item, any_value(n) AS n, max(t) FILTER (r = 1) AS t1, max(j) FILTER (r = 1) AS j1,
               max(t) FILTER (r = 2) AS t2, max(j) FILTER (r = 2) AS j2, max(t) FILTER (r = 3) AS t3, max(j) FILTER (r = 3) AS j3 FROM rk GROUP BY win),
        c1 AS (SELECT DISTINCT doc_id, item, n, p - j1 AS s, t2, j2, t3, j3 FROM ra JOIN tk ON tk.t = t1),
        c2 AS (SELECT DISTINCT c1.* FROM c1 JOIN tk ON n > 1 AND tk.doc_id = c1.doc_id AND tk.t = t2 AND tk.p BETWEEN s + j2 - 3 AND s + j2 + 3 UNION ALL SELECT * FROM c1 WHERE n = 1),
        c3 AS (SELECT DISTINCT c2.doc_id, item FROM c2 JOIN tk ON n > 2 AND tk.doc_id = c2.doc_id AND tk.t = t3 AND tk.p BETWEEN s + j3 - 3 AND s + j3 + 3 UNION SELECT doc_id, item FROM c2 WHERE n < 3),
        nr AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item FROM c3 EXCEPT SELECT doc_id, item FROM ex) GROUP BY ALL)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM w LEFT JOIN hc ON hc.doc_id = w.doc_id LEFT JOIN it ON it.doc_id = w.doc_id LEFT JOIN nr ON nr.doc_id = w.doc_id""",
    "op8_neighbours": f"""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {_COSINE} AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, c.vec_id) AS rank
            FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        WHERE rank <= 5""",
    "op9_chat": """
        WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        calls AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM m WHERE role = 'user'),
        results AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM m WHERE role = 'assistant'),
        one AS (SELECT conv_id, call_id, min(text) AS content, count(*) AS n_results FROM results GROUP BY ALL),
        lines AS (
            SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, depth, coalesce(o.n_results, 0) AS n_results, length(c.text) BETWEEN 16 AND 256 AS valid,
                   '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":' || CAST(to_json(c.call_id) AS VARCHAR) || ',"name":"reply"'
                   || CASE WHEN o.content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(o.content) AS VARCHAR) END || '}' AS json
            FROM calls c LEFT JOIN one o ON c.conv_id = o.conv_id AND c.call_id = o.call_id
            UNION ALL
            SELECT r.conv_id, r.turn, 'result', r.call_id, c.depth, o.n_results, TRUE, '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":' || CAST(to_json(r.call_id) AS VARCHAR) || '}'
            FROM results r JOIN one o ON r.conv_id = o.conv_id AND r.call_id = o.call_id AND o.n_results > 1
            JOIN (SELECT DISTINCT conv_id, call_id, depth FROM calls) c ON c.conv_id = r.conv_id AND c.call_id = r.call_id
            UNION ALL
            SELECT conv_id, turn, 'message', NULL, 0, 0, TRUE, '{"role":' || CAST(to_json(role) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}'
            FROM (SELECT conv_id, turn, role, text FROM m WHERE role NOT IN ('user', 'assistant')
                  UNION ALL
                  SELECT conv_id, turn, 'assistant', text FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)))
        SELECT conv_id, turn, kind, call_id, CAST(depth AS INTEGER) AS depth, n_results, valid, CAST(length(json) AS BIGINT) AS n_json, sha256(json) AS json_sha256 FROM lines""",
}
