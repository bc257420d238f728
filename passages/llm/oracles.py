"""The same results in SQL for DuckDB, where SQL can express them."""

from passages.llm.exact import LOWER, UPPER
from passages.llm.licences import NOT_WORD, SIMILARITY, TEMPLATES, bigrams, words

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sized(text: str) -> str:
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _template(name: str, text: str) -> str:
    pairs = ", ".join(_quoted(f"{a} {b}") for a, b in sorted(bigrams(words(text))))
    return f"({_quoted(name)}, [{pairs}])"


ORACLES: dict[str, str] = {
    "op1_substrings": f"""
WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
repeated AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (t)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
    "op3_exact_duplicates": f"""
WITH norm AS (SELECT doc_id, {_LOWERED} AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM norm JOIN groups USING (text)""",
    "op8_jaccard": f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN
      list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o
  FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * o >= 80 * (n + m - o)),
reached AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION SELECT b, root FROM reached JOIN links ON a = doc_id),
components AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN components USING (doc_id)""",
    "op9_licences": f"""
WITH templates(licence, pairs) AS (VALUES {", ".join(_template(*t) for t in TEMPLATES.items())}),
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, list_filter(list_transform(
      regexp_split_to_array(unnest(l), '{NOT_WORD}'), lambda w: trim(w, '.')), lambda w: w <> '') AS w
  FROM (SELECT doc_id, string_split({_LOWERED}, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
numbered AS (
  SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM lines),
paragraphs AS (
  SELECT doc_id, min(line) AS line, count(*) AS n_lines, flatten(list(w ORDER BY line)) AS w
  FROM numbered WHERE len(w) > 0 GROUP BY doc_id, p),
parts AS (
  SELECT doc_id, line, 1 AS n_lines, w FROM lines
  UNION ALL SELECT * FROM paragraphs WHERE n_lines > 1
  UNION ALL SELECT doc_id, 0, count(*), flatten(list(w ORDER BY line)) FROM lines
    SEMI JOIN (SELECT doc_id FROM paragraphs GROUP BY doc_id HAVING count(*) > 1) USING (doc_id)
    GROUP BY doc_id),
sets AS (
  SELECT doc_id, line, n_lines, list_distinct(list_transform(range(1, len(w)),
      lambda i: w[i] || ' ' || w[i + 1])) AS own FROM parts WHERE len(w) > 1),
scored AS (
  SELECT *, 2.0 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS score
  FROM sets JOIN templates
    ON 2 * least(len(own), len(pairs)) >= {SIMILARITY} * (len(own) + len(pairs)) - 0.001)
SELECT doc_id, line::BIGINT AS line, n_lines::BIGINT AS n_lines, licence, round(score, 6)::DOUBLE AS dice,
       len(own)::BIGINT AS n_bigrams
FROM scored WHERE score >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, line, n_lines ORDER BY score DESC, licence) = 1""",
    # For pages like those of the tables: one article of paragraphs and a heading.
    "op10_extraction": r"""
WITH blocks AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(
      regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<br>', ' ', 'g'),
    '</?(?:p|h1)>') AS b FROM pages),
plain AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
      replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
      '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM blocks)
SELECT page_id, url, array_to_string(b, chr(10)) AS text,
       length(array_to_string(b, chr(10)))::BIGINT AS n_chars FROM plain""",
    "op12_manifest": f"""
WITH RECURSIVE crcs AS (
  SELECT DISTINCT doc_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, step: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
    4294967295::BIGINT) AS crc
  FROM documents),
rows AS (
  SELECT doc_id, lang, crc % 3 = 0 AS altered,
         {_sized("doc_id::VARCHAR")} || {_sized("source")} || {_sized("lang")}
           || {_sized("n_chars::VARCHAR")} AS known,
         {_sized("text")} AS plain, {_sized(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed
  FROM documents LEFT JOIN crcs USING (doc_id)),
digests AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(known || plain) AS leaf,
         sha256(known || CASE WHEN altered THEN changed ELSE plain END) AS claim FROM rows),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM digests),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8),
roots AS MATERIALIZED (
  SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS level, place, n, digest FROM roots
  UNION ALL
  SELECT level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM uppers WHERE n > 1 GROUP BY level, place // 8),
runs AS MATERIALIZED (
  SELECT tree, level, place // 8 AS run, list(digest ORDER BY place) AS digests
  FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, place // 8, list(digest ORDER BY place) FROM uppers WHERE n > 1 GROUP BY ALL),
folds AS (
  SELECT doc_id, leaf, tree, tree AS own, 0 AS level, place, claim AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, leaf, tree, own, level + 1, place // 8,
         sha256(array_to_string(before, '') || node || array_to_string(after, '')),
         proof || array_to_string(before, '') || array_to_string(after, '')
  FROM (SELECT f.*, digests[: f.place % 8] AS before, digests[f.place % 8 + 2 :] AS after
        FROM folds f JOIN runs r ON f.own = r.tree AND f.level = r.level AND f.place // 8 = r.run)),
climbs AS (
  SELECT f.doc_id, f.leaf, f.tree, 0 AS level, r.place, f.node, f.proof
  FROM (SELECT * FROM folds QUALIFY level = max(level) OVER (PARTITION BY tree)) f
    JOIN roots r USING (tree)
  UNION ALL
  SELECT doc_id, leaf, tree, level + 1, place // 8,
         sha256(array_to_string(before, '') || node || array_to_string(after, '')),
         proof || array_to_string(before, '') || array_to_string(after, '')
  FROM (SELECT c.*, digests[: c.place % 8] AS before, digests[c.place % 8 + 2 :] AS after
        FROM climbs c JOIN runs r ON r.tree IS NULL AND c.level = r.level AND c.place // 8 = r.run))
SELECT doc_id, leaf, roots.digest AS subroot, uppers.digest AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = uppers.digest AS verified
FROM (SELECT * FROM climbs QUALIFY level = max(level) OVER ()) JOIN roots USING (tree)
  JOIN uppers ON uppers.n = 1""",
    "op13_divergence": f"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
terms AS (SELECT doc, lang, source, unnest(t) AS term FROM texts),
kept AS MATERIALIZED (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM texts),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source)
  GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v))::HUGEINT AS p
  FROM totals JOIN kinds USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
wholes AS (SELECT lang, sum(total) AS whole FROM totals GROUP BY lang),
usual AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(whole) + any_value(v)))::HUGEINT AS q
  FROM counts JOIN wholes USING (lang) JOIN kinds USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT
  FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM every)
WHERE part = 'pair' OR rank <= 200""",
}
