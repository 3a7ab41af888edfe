"""DuckDB SQL for the operators that SQL can express, over the tables as views.

The statements use windows over single words and bytes, so they are for small tables.
"""

from __future__ import annotations

from notelake.llm import quality
from notelake.llm.resampling import crc_table

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

_WORDS = f"""words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents))"""


def _windows(n: int) -> str:
    """The n words from each one on, joined; null where there are fewer."""
    return " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, n))])


# op9: a word is removed if one of the 13 windows that hold it also starts in a document with a smaller id
WORD_REPEATS = f"""
WITH {_WORDS},
windows AS (SELECT doc_id, pos, word, {_windows(13)} AS key FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows WHERE key IS NOT NULL GROUP BY key),
marked AS (SELECT w.doc_id, w.pos, w.word, coalesce(f.first < w.doc_id, false) AS again FROM windows w LEFT JOIN firsts f ON f.key = w.key),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)"""


def _longest(n: int = 13, most: int = 11) -> str:
    """For each document the longest of n, 2 n, 4 n, ... words (up to n 2**most) of a window that another document has too."""
    steps, found, last = [], [], "w0"
    for k in range(most + 1):
        size = n << k
        if k:
            steps.append(f"w{k} AS (SELECT *, CASE WHEN lead(h{k - 1}, {size // 2}) OVER o IS NOT NULL THEN hash(h{k - 1}, lead(h{k - 1}, {size // 2}) OVER o) END AS h{k} FROM {last} WINDOW o AS (PARTITION BY doc_id ORDER BY pos))")
            last = f"w{k}"
        found.append(f"SELECT doc_id, {size} AS words FROM w{k} WHERE h{k} IN (SELECT h{k} FROM w{k} WHERE h{k} IS NOT NULL GROUP BY h{k} HAVING min(doc_id) < max(doc_id))")
    first = f"w0 AS (SELECT doc_id, pos, CASE WHEN key IS NOT NULL THEN hash(key) END AS h0 FROM (SELECT doc_id, pos, {_windows(n)} AS key FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)))"
    return f"WITH {_WORDS},\n{', '.join([first, *steps])},\nfound AS ({' UNION ALL '.join(found)})\nSELECT d.doc_id, CAST(coalesce(max(f.words), 0) AS BIGINT) AS words FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"


def _doubled(length: int) -> tuple[str, str]:
    """Statements that hash 1, 2, 4, ... bytes from each one on, and the hash of ``length`` of them."""
    steps, size, last = [], 1, "bytes"
    while 2 * size <= length:
        steps.append(f"h{2 * size} AS (SELECT *, CASE WHEN lead(h{size}, {size}) OVER o IS NOT NULL THEN hash(h{size}, lead(h{size}, {size}) OVER o) END AS h{2 * size} FROM {last} WINDOW o AS (PARTITION BY doc_id ORDER BY pos))")
        size, last = 2 * size, f"h{2 * size}"
    parts, at = [], 0
    while size:
        if length - at >= size:
            parts.append(f"lead(h{size}, {at}) OVER o")
            at += size
        size //= 2
    whole = f"whole AS (SELECT doc_id, pos, byte, CASE WHEN {' AND '.join(p + ' IS NOT NULL' for p in parts)} THEN hash({', '.join(parts)}) END AS key FROM {last} WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"
    return ",\n".join(steps), whole


_STEPS, _WHOLE = _doubled(400)

# op4: a byte is removed if one of the 400 strings that hold it starts anywhere else too
BYTE_REPEATS = f"""
WITH bytes AS (SELECT doc_id, unnest(b) AS byte, generate_subscripts(b, 1) AS pos, hash(unnest(b)) AS h1 FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents)),
{_STEPS},
{_WHOLE},
twice AS (SELECT key FROM whole WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
marked AS (SELECT w.doc_id, w.pos, w.byte, t.key IS NOT NULL AS again FROM whole w LEFT JOIN twice t ON t.key = w.key),
last AS (SELECT *, max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS latest FROM marked),
covered AS (SELECT doc_id, pos, byte, coalesce(pos - latest < 400, false) AS gone FROM last),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM covered),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS rest FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_bytes, 0) AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.rest, ''))) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)"""

# op8: single linkage at 0.8 over multisets of five-word shingles; documents of fewer words have one shingle of all of them
NEAR_DUPLICATES = f"""
WITH RECURSIVE {_WORDS},
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
shingled AS (SELECT doc_id, {_windows(5)} AS s FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
bags AS (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, s FROM shingled WHERE s IS NOT NULL
    UNION ALL SELECT doc_id, n || ':' || string_agg(word, ' ' ORDER BY pos) FROM words JOIN sizes USING (doc_id) WHERE n < 5 GROUP BY doc_id, n) GROUP BY doc_id, s),
totals AS (SELECT doc_id, sum(c) AS total FROM bags GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS n FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN totals x ON x.doc_id = a JOIN totals y ON y.doc_id = b WHERE CAST(n AS DOUBLE) / CAST(x.total + y.total - n AS DOUBLE) >= 0.8),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other),
classes AS (SELECT id AS doc_id, min(other) AS class_id FROM reached GROUP BY id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM classes"""


def _quality() -> str:
    """The SQL of op10 with its fixed values."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda chars: f"length(text) - length(translate(text, {chars}, ''))"
    chars = {k: " || ".join(lit(c) if c.isprintable() else f"chr({ord(c)})" for c in v) for k, v in quality.CLASSES.items()}
    classes = ", ".join(f"{count(v)} AS {k}_" for k, v in chars.items())
    known = " + ".join(f"{k}_" for k in chars)
    bins = " UNION ALL ".join([*(f"SELECT doc_id, lang, '{k}' AS bin, {k}_ AS n FROM counted" for k in chars), f"SELECT doc_id, lang, 'ascii', length(text) - beyond_ - ({known}) FROM counted", "SELECT doc_id, lang, 'beyond', beyond_ FROM counted"])
    vocabulary = ", ".join(lit(w) for w in sorted({w for ws in quality.COMMON_WORDS.values() for w in ws}))
    langs = ", ".join(lit(k) for k in quality.COMMON_WORDS)

    def distance(name: str) -> str:
        return f"""
{name}_total AS (SELECT doc_id, sum(n) AS total FROM {name}_bins GROUP BY doc_id),
{name}_reference AS (SELECT lang, bin, sum(n) AS n FROM {name}_bins WHERE lang IN (SELECT lang FROM spoken) GROUP BY lang, bin UNION ALL SELECT '', bin, sum(n) FROM {name}_bins WHERE NOT EXISTS (SELECT 1 FROM spoken) GROUP BY bin),
{name}_shares AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM {name}_reference),
{name}_parts AS (
  SELECT b.doc_id, l.lang, b.n / t.total AS p, coalesce(s.q, 0) AS q FROM {name}_bins b JOIN {name}_total t USING (doc_id) CROSS JOIN (SELECT DISTINCT lang FROM {name}_shares) l
  LEFT JOIN {name}_shares s ON s.lang = l.lang AND s.bin = b.bin WHERE b.n > 0),
{name}_js AS (SELECT doc_id, lang, sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 + (1 - sum(q)) / 2 AS js FROM {name}_parts GROUP BY doc_id, lang),
{name}_near AS (SELECT doc_id, sqrt(greatest(0, least(1, min(js)))) AS distance FROM {name}_js GROUP BY doc_id)"""

    return f"""
WITH {_WORDS.replace("SELECT doc_id, unnest", "SELECT doc_id, lang, unnest").replace("(SELECT doc_id, regexp", "(SELECT doc_id, lang, regexp")},
counted AS (SELECT doc_id, lang, text, {classes}, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS beyond_ FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
class_bins AS ({bins}),
word_bins AS (SELECT doc_id, lang, CASE WHEN w IN ({vocabulary}) THEN w ELSE ' other' END AS bin, count(*) AS n FROM (SELECT doc_id, lang, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM words) GROUP BY 1, 2, 3),
spoken AS (SELECT DISTINCT lang FROM words WHERE lang IN ({langs})),
{distance("class")},
{distance("word")},
windows AS (SELECT doc_id, pos, {_windows(5)} AS key FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (SELECT doc_id, pos, key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1 AS again FROM windows),
covered AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gone FROM marked),
repeats AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_repeat FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, sum(n - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM counted) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line) GROUP BY doc_id),
base AS (
  SELECT c.doc_id, coalesce(r.n_words, 0) AS n_words, length(regexp_replace(c.text, '{BLANK}', '', 'g')) AS word_chars, c.symbol_ AS n_symbols, CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n_repeat, 0) AS n_repeat_words,
    CASE WHEN length(c.text) >= {quality.MIN_CHARS} THEN a.distance END AS class_distance, CASE WHEN coalesce(r.n_words, 0) >= {quality.MIN_WORDS} THEN b.distance END AS word_distance
  FROM counted c LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN class_near a USING (doc_id) LEFT JOIN word_near b USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (coalesce(class_distance > {quality.MAX_CLASS_DISTANCE}, false) OR coalesce(word_distance > {quality.MAX_WORD_DISTANCE} + {quality.SHORT_SURPLUS} * greatest(1 / sqrt(n_words) - 1 / sqrt({quality.FULL_WORDS}), 0), false)) AS kept FROM base"""


QUALITY = _quality()

_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, a table look-up for each byte."""
    table = ", ".join(map(str, crc_table()))
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES.format(text)}), lambda a, b: xor(a >> 8, CAST(list_extract([{table}], CAST((xor(a, b) & 255) + 1 AS BIGINT)) AS BIGINT))), 4294967295)"


# op11: every pair of a query and another row; sums run from the first component to the last, as in the operator
NEAREST = """
WITH lengths AS (SELECT len(embedding) AS dim, count(*) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY n DESC, dim DESC LIMIT 1),
rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings, lengths
  WHERE vec_id IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = dim AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM rows),
pairs AS (
  SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND (q.vec_id <> c.vec_id OR q.e <> c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_SMALL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# op12: gains of 10,000 buckets from the counts of both sides, Gumbel noise from each id's hash
RESAMPLING = f"""
WITH said AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all({_SMALL.format("text")}, '{_NAMES}') AS ws FROM documents),
used AS (SELECT nr, unnest(ws) AS w FROM said),
asked AS (SELECT unnest(regexp_extract_all({_SMALL.format("text")}, '{_NAMES}')) AS w FROM benchmark),
buckets AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM used UNION SELECT w FROM asked)),
s AS (SELECT b, count(*) AS n FROM used JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM asked JOIN buckets USING (w) GROUP BY b),
sums AS (SELECT CAST((SELECT count(*) FROM used) AS DOUBLE) AS ss, CAST((SELECT count(*) FROM asked) AS DOUBLE) AS tt),
gains AS (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b) CROSS JOIN sums),
weights AS (SELECT nr, CAST(sum(gain) AS BIGINT) AS weight FROM used JOIN buckets USING (w) JOIN gains USING (b) GROUP BY nr),
scored AS (
  SELECT nr, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM said LEFT JOIN weights USING (nr)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed"""


def _merkle() -> str:
    """The SQL of op13."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    leaf = lambda n: f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', n, 'text'))})"
    up = lambda name, start: f"""{name} AS (
  SELECT tree, 0 AS level, place AS i, n, digest FROM {start}
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n)"""  # noqa: E731
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang AS tree, digest, other, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {leaf("n_chars")} AS digest, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS other FROM documents)
  WINDOW o AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest)),
{up("leaves_up", "leaves")},
subroots AS (SELECT tree AS lang, digest FROM leaves_up WHERE n = 1),
trees AS (SELECT 'all' AS tree, lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM subroots),
{up("trees_up", "trees")},
levels AS (SELECT DISTINCT 0 AS part, tree AS of, level, n FROM leaves_up WHERE n > 1 UNION ALL SELECT DISTINCT 1, NULL, level, n FROM trees_up WHERE n > 1),
own AS (
  SELECT l.tree, l.place, 0 AS part, s.level, (l.place >> s.level) % 2 AS odd, u.digest AS sibling
  FROM leaves l JOIN levels s ON s.part = 0 AND s.of IS NOT DISTINCT FROM l.tree LEFT JOIN leaves_up u ON u.tree IS NOT DISTINCT FROM l.tree AND u.level = s.level AND u.i = xor(l.place >> s.level, 1)),
top AS (
  SELECT t.lang AS tree, s.level, (t.place >> s.level) % 2 AS odd, u.digest AS sibling
  FROM trees t JOIN levels s ON s.part = 1 LEFT JOIN trees_up u ON u.level = s.level AND u.i = xor(t.place >> s.level, 1)),
steps AS (SELECT * FROM own UNION ALL SELECT l.tree, l.place, 1, t.level, t.odd, t.sibling FROM leaves l JOIN top t ON t.tree IS NOT DISTINCT FROM l.tree),
proofs AS (
  SELECT tree, place, string_agg(sibling, '' ORDER BY part, level) AS proof, list(CASE WHEN sibling IS NULL THEN '-' WHEN odd = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY part, level) AS way FROM steps GROUP BY tree, place),
folded AS (
  SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.other, l.digest), coalesce(p.way, [])), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
  FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.tree CROSS JOIN (SELECT digest FROM trees_up WHERE n = 1) r LEFT JOIN proofs p ON p.tree IS NOT DISTINCT FROM l.tree AND p.place = l.place)
SELECT *, folded_root = root AS verified FROM folded"""


MERKLE = _merkle()

ORACLE_SQL = {"sentencepiece_parity": "SELECT doc_id FROM documents WHERE false", "longest_word_repeats": _longest(), "op9_word_repeats": WORD_REPEATS, "op4_suffix_array": BYTE_REPEATS, "op8_bagminhash": NEAR_DUPLICATES, "op10_quality_rules": QUALITY, "op11_learned_partitions": NEAREST, "op12_resampling": RESAMPLING, "op13_merkle_manifest": MERKLE}
