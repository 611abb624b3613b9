"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from vecloom.llm import licenses, quality

WORD = r"[^\x20\x09-\x0D]+"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality() -> str:
    common = " ".join(f"WHEN '{lang}' THEN [{', '.join(map(_literal, words))}]" for lang, words in quality.COMMON.items())
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    # the classes take what is left in turn: symbols come before digits and the other printable characters
    chars = ["length(t) - word_chars", count("[a-z]"), count("[A-Z]"), "n_symbols", count("[0-9]"), f"{count('[!-~]')} - {count('[A-Za-z0-9]')} - n_symbols", f"word_chars - {count('[!-~]')}"]
    jsd = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda k: (CASE WHEN {p}[k] > 0 THEN {p}[k] * ln({p}[k] / (({p}[k] + {q}[k]) / 2)) ELSE 0 END) + (CASE WHEN {q}[k] > 0 THEN {q}[k] * ln({q}[k] / (({p}[k] + {q}[k]) / 2)) ELSE 0 END))) / (2 * ln(2.0))))"
    mean = lambda h, n: "[" + ", ".join(f"avg({h}[{k}])" for k in range(1, n + 1)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(map(_literal, quality.COMMON))}) THEN lang ELSE '*' END AS key FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM d),
grams AS (SELECT id, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
met AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, x, y, z) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM met) GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY id),
base AS (SELECT w.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count('[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN lines USING (id) LEFT JOIN repeats USING (id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{', '.join(f'CAST({c} AS DOUBLE)' for c in chars)}] AS c, list_transform(CASE key {common} ELSE [{', '.join(map(_literal, quality.COMMON['en']))}] END, lambda x: CAST(len(list_filter(w, lambda y: y = x)) AS DOUBLE)) AS f FROM base),
shares AS (SELECT *, list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN x / list_sum(c) ELSE 0 END) AS p, list_transform(list_append(f, n_words - list_sum(f)), lambda x: CASE WHEN n_words > 0 THEN x / n_words ELSE 0 END) AS v FROM judged),
refs AS (SELECT key, {mean('p', 7)} AS rp, {mean('v', 11)} AS rv FROM shares WHERE n_words >= 100 AND NOT base_failed GROUP BY key),
far AS (SELECT shares.*, (word_chars >= 300 AND {jsd('p', 'rp')} > {quality.MAX_CHAR_JSD}) OR (n_words >= 100 AND {jsd('v', 'rv')} > {quality.MAX_WORD_JSD}) AS far FROM shares LEFT JOIN refs USING (key))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept FROM far"""


NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)), ' ')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""


def _licenses() -> str:
    def canonical(text):
        out = f"regexp_replace(lower({text}), {_literal(licenses.WRAPPED)}, '\\1 -\\2', 'g')"
        out = f"regexp_replace({out}, {_literal(licenses.NOTICE)}, '', 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for a, b in licenses.SPELLINGS.items():
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"sha256(trim({out}))"

    texts = [(k, v) for k, v in licenses.KNOWN.items()] + [(k, v.partition("\n\n")[2]) for k, v in licenses.KNOWN.items()]
    listed = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in texts)
    digests = ", ".join(f"('{k}', '{v}')" for k, v in licenses.DIGESTS.items())
    return f"WITH known AS (SELECT license_id, {canonical('text')} AS digest FROM (VALUES {listed}) t(license_id, text) UNION ALL SELECT * FROM (VALUES {digests}) t(license_id, digest)), k AS (SELECT digest, min(license_id) AS license_id FROM known WHERE digest <> sha256('') GROUP BY digest) SELECT doc_id, digest, license_id FROM (SELECT doc_id, {canonical('text')} AS digest FROM documents) LEFT JOIN k USING (digest)"


_PART = "('0x' || substr(digest, {}, 8))::BIGINT"

TIMELINE = f"""
WITH d AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
e AS (SELECT *, {_PART.format(1)} % 200000 AS event FROM d),
v AS (SELECT doc_id, source, n_chars, lang, event, event - 60 + {_PART.format(9)} % 1200 AS arrival, event + {_PART.format(17)} % 900 AS expiry FROM e),
of AS (SELECT doc_id, max(source) AS source FROM documents GROUP BY doc_id),
asked AS (SELECT row_number() OVER () AS r, l.doc_id, {_PART.format(25)} % 200000 AS t FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS digest FROM labels) l),
met AS (SELECT r, asked.doc_id, t, v.doc_id AS version_id, t - event AS age, v.n_chars, v.lang, row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival DESC, v.doc_id DESC) AS k
FROM asked LEFT JOIN of ON of.doc_id = asked.doc_id LEFT JOIN v ON v.source = of.source AND event <= t AND arrival <= t AND t < expiry)
SELECT doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 20 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN age <= 20 THEN n_chars END AS n_chars, CASE WHEN age <= 20 THEN lang END AS lang FROM met WHERE k = 1"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""


ORACLE = {"op2_distribution_divergence": _quality(), "op4_bbit_minhash": NEAR, "op6_count_min_windows": WINDOWS, "op8_license_digest": _licenses(), "op11_painted_timeline": TIMELINE, "op13_bit_sliced_negatives": NEGATIVES}
