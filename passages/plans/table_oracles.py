"""The same results in SQL for DuckDB, written without regard to the Spark plans."""

from passages.functions.text import PRETOKEN, WATCH_URL, WHITESPACE
from passages.operators.chunking import RESERVED_TOKENS
from passages.operators.prompts import DEFAULT_TEMPLATE
from passages.plans.table_queries import CHUNK_OVERLAP, CHUNK_SIZE, DIM, LATER, REFUSED, K


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VIDEOS = """
SELECT source AS channel_id, doc_id::VARCHAR AS video_id, lang AS title,
       epoch(make_timestamp(2024, 1, doc_id % 28 + 1, 16, 3, 23))::BIGINT AS published
FROM documents"""

TRANSCRIPTS = """
SELECT source AS channel_id, doc_id::VARCHAR AS video_id, lang AS title, turn, c.text AS caption
FROM documents JOIN conversations c ON c.conv_id = doc_id"""

WHOLE_CONTENT = f"""
SELECT channel_id, video_id, title, string_agg(caption, ' ' ORDER BY turn) AS content
FROM ({TRANSCRIPTS}) GROUP BY channel_id, video_id, title"""


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, {_quoted(PRETOKEN)}))"


def _chunks_tokens(columns: str, chunk_size: int, overlap: int) -> str:
    """Pieces as nodes on the line of their cumulated counts; from each node the end
    of its passage and the node where the next begins; then the chain from node 0."""
    size = chunk_size - RESERVED_TOKENS
    split = (
        "list_transform(string_split({text}, {sep}), lambda s, i: CASE WHEN i = 1 THEN s"
        " ELSE {sep} || s END)"
    )
    by_blank = split.format(text="text", sep="' '")
    by_line = split.format(text="p", sep="chr(10)")
    strip = f"trim({{}}, {_quoted(WHITESPACE)})"

    def split_long(pieces: str, parts: str) -> str:
        return (
            f"flatten(list_transform({pieces}, lambda p:"
            f" CASE WHEN {_count('p')} > {size} THEN {parts} ELSE [p] END))"
        )

    return f"""
WITH RECURSIVE whole AS (
  SELECT doc_id, source, lang, text, {_count("text")} AS n FROM documents),
blank AS (SELECT doc_id, list_filter({by_blank}, lambda p: p <> '') AS pieces
          FROM whole WHERE n > {size}),
line AS (SELECT doc_id, {split_long("pieces", f"list_filter({by_line}, lambda s: s <> '')")} AS pieces
         FROM blank),
pieces AS MATERIALIZED (
  SELECT doc_id, {split_long("pieces", "string_split(p, '')")} AS pieces FROM line),
piece AS (SELECT doc_id, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM pieces),
node AS MATERIALIZED (
  SELECT doc_id, i, sum({_count("p")}) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c
  FROM piece UNION ALL SELECT doc_id, 0, 0 FROM pieces),
reach AS (
  SELECT doc_id, i, c, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS following_c,
         i + count(*) OVER (PARTITION BY doc_id ORDER BY c
             RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) - 1 AS last
  FROM node),
back AS (
  SELECT doc_id, i, last, i + 1 - count(*) OVER (PARTITION BY doc_id ORDER BY c
             RANGE BETWEEN least({overlap}, c - following_c + {size}) PRECEDING AND CURRENT ROW) AS restart
  FROM reach WHERE following_c IS NOT NULL
  UNION ALL SELECT doc_id, i, i, NULL FROM reach WHERE following_c IS NULL),
step AS MATERIALIZED (
  SELECT b.doc_id, b.i, b.last, e.restart FROM back b JOIN back e ON e.doc_id = b.doc_id AND e.i = b.last),
chain AS (
  SELECT doc_id, i, last, restart FROM step WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.i, s.last, s.restart FROM chain JOIN step s
    ON s.doc_id = chain.doc_id AND s.i = chain.restart),
cut AS (
  SELECT doc_id, i, {strip.format("array_to_string(pieces[i + 1 : last], '')")} AS content
  FROM chain JOIN pieces USING (doc_id)
  UNION ALL
  SELECT doc_id, 0, {strip.format("text")} FROM whole WHERE n <= {size}),
numbered AS (
  SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n
  FROM cut WHERE content <> '')
SELECT source || '_' || doc_id || '_' || numbered.n AS id, {columns}
FROM numbered JOIN documents USING (doc_id)"""


_STRIDE = CHUNK_SIZE - CHUNK_OVERLAP
PASSAGES = f"""
word AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w
         FROM documents),
span AS (SELECT *, unnest(range(0, 1 + greatest(0,
           ceil((len(w) - {CHUNK_SIZE}) / {_STRIDE}.0)::BIGINT))) AS i FROM word),
passages AS MATERIALIZED (
  SELECT source || '_' || doc_id || '_' || i AS id, source AS channel_id,
         doc_id::VARCHAR AS video_id, lang AS title,
         array_to_string(w[i * {_STRIDE} + 1 : i * {_STRIDE} + {CHUNK_SIZE}], ' ') AS content
  FROM span)"""


def _vectors(name: str, source: str, key: str, text: str) -> str:
    """``name(key, v)``: hashed word counts at unit length, as floats."""
    words = f"list_filter(string_split_regex(lower({text}), '[ \\t\\r\\n]+'), lambda x: x <> '')"
    return f"""
{name}_b AS (SELECT {key}, list_transform({words},
    lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {DIM}) AS b FROM {source}),
{name}_n AS (SELECT {key}, list_transform(range({DIM}),
    lambda i: len(list_filter(b, lambda x: x = i))) AS n FROM {name}_b),
{name} AS MATERIALIZED (SELECT {key}, list_transform(n, lambda x:
    (x / greatest(sqrt(list_sum(list_transform(n, lambda y: y * y))), 1))::FLOAT) AS v
    FROM {name}_n)"""


def _distance(a: str, b: str) -> str:
    """Squares summed in the order of the dimensions, so that equal distances stay equal."""
    return (
        f"list_reduce(list_transform(list_zip({a}, {b}), lambda z:"
        " (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda x, y: x + y)"
    )


def _rounded(hits: str) -> str:
    return f"SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({hits})"


def _ranked(pairs: str) -> str:
    return (
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank"
        f" FROM ({pairs}) QUALIFY rank <= {K}"
    )


def _knn(vector: str, asked: str = "true") -> str:
    """Neighbours among vectors of the same length, of which every number is finite."""
    own = (
        f"SELECT vec_id, {vector} AS v FROM embeddings"
        " WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0"
    )
    pairs = (
        f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_distance('q.v', 'e.v')} AS distance"
        f" FROM ({own}) q JOIN ({own}) e ON len(q.v) = len(e.v) WHERE {asked}"
    )
    return _rounded(_ranked(pairs))


KNN = _knn("embedding")
KNN_HUNDREDTH = _knn("embedding", "q.vec_id % 100 = 0")

LONG_VECTORS = f"""
WITH {PASSAGES}, {_vectors("vectors", "passages", "id", "content")}
SELECT id, bucket, round(weight::DOUBLE, 6) AS weight
FROM (SELECT id, unnest(v) AS weight, generate_subscripts(v, 1) - 1 AS bucket FROM vectors)
WHERE weight <> 0"""

def _retrieval(vector: str) -> str:
    distances = (
        f"SELECT item_id AS query_id, id, {_distance('q.v', vector)} AS distance"
        " FROM questions q, vectors p"
    )
    return f"""
WITH {PASSAGES}, {_vectors("vectors", "passages", "id", "content")},
{_vectors("questions", "benchmark", "item_id", "text")},
hits AS MATERIALIZED ({_ranked(distances)})"""


_RETRIEVAL = _retrieval("p.v")

_BEFORE, _BETWEEN = DEFAULT_TEMPLATE.split("{context}")
_BETWEEN, _AFTER = _BETWEEN.split("{input}")
_PROMPT = (
    f"{_quoted(_BEFORE)} || string_agg(content, chr(10) || chr(10) ORDER BY rank)"
    f" || {_quoted(_BETWEEN)} || any_value(b.text) || {_quoted(_AFTER)}"
)
_ANSWERABLE = "hits JOIN passages USING (id) JOIN benchmark b ON b.item_id = query_id"

_SIDE = "SELECT lang, source, round({n}, 2) AS length FROM documents"
_LEFT = _SIDE.format(n="n_chars / 7.0")
_RIGHT = _SIDE.format(n="n_chars / 7.0 + CASE WHEN source = 'src1' THEN 1 ELSE 0 END")
_WITH_NULLS = "SELECT nullif(lang, 'en') AS lang, source, doc_id FROM documents"


def _excess(a: str, b: str, side: str) -> str:
    return (
        f"SELECT lang, source, length, '{side}' AS side, count(*) AS copies"
        f" FROM ({a} EXCEPT ALL {b}) GROUP BY ALL"
    )


ORACLES = {
    "channel_listing": f"SELECT DISTINCT * FROM ({VIDEOS})",
    "videos_distinct": f"SELECT DISTINCT * FROM ({VIDEOS} UNION ALL {VIDEOS})",
    "captions_by_language": """
SELECT conv_id::VARCHAR AS video_id, count(*) AS n_captions,
       string_agg(text, '|' ORDER BY turn) AS texts
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    "video_transcripts": f"""
SELECT channel_id, video_id, title, count(*) AS n_captions,
       string_agg(caption, '|' ORDER BY turn) AS texts
FROM ({TRANSCRIPTS}) GROUP BY channel_id, video_id, title""",
    "missing_transcripts": f"""
SELECT source AS channel_id, doc_id::VARCHAR AS video_id, lang AS title,
       {_quoted(WATCH_URL)} || doc_id AS url
FROM documents WHERE NOT EXISTS (FROM conversations WHERE conv_id = doc_id)""",
    "caption_failures": f"""
SELECT source AS channel_id, doc_id::VARCHAR AS video_id, lang AS title,
       {_quoted(WATCH_URL)} || doc_id AS url,
       CASE WHEN lang = 'en' THEN 'NotFound' END AS error_type,
       CASE WHEN lang = 'en' THEN 'no captions of ' || doc_id END AS error_cause
FROM documents WHERE NOT EXISTS (FROM conversations WHERE conv_id = doc_id)""",
    "transcripts_flat": f"""
SELECT channel_id, video_id, title, turn::DOUBLE AS start, caption AS text
FROM ({TRANSCRIPTS})""",
    "content": WHOLE_CONTENT,
    "content_from_stream": WHOLE_CONTENT,
    "content_from_captions": """
SELECT conv_id::VARCHAR AS video_id, string_agg(text, ' ' ORDER BY turn) AS content
FROM conversations GROUP BY conv_id""",
    "token_counts": f"""
SELECT doc_id::VARCHAR AS video_id, {_count("text")} AS n_tokens FROM documents""",
    "chunks_words": f"WITH {PASSAGES} SELECT * FROM passages",
    "chunks_tokens": _chunks_tokens(
        "source AS channel_id, doc_id::VARCHAR AS video_id, lang AS title, content",
        CHUNK_SIZE,
        CHUNK_OVERLAP,
    ),
    "chunks_tokens_large": _chunks_tokens("content", 500, 50),
    "chunks_tokens_small": _chunks_tokens("content", 10, 2),
    "chunk_vectors": LONG_VECTORS,
    "chunk_vectors_udf": LONG_VECTORS,
    "failed_texts": f"SELECT doc_id FROM documents WHERE contains(text, {_quoted(REFUSED)})",
    "knn_exact": KNN,
    "knn_ivf": KNN,
    "knn_stored_cells": KNN,
    "knn_join": KNN_HUNDREDTH,
    "knn_codes": KNN_HUNDREDTH,
    "knn_codes_recall": """
SELECT count(*) AS n_questions, true AS recall_reached, true AS exact_distances
FROM embeddings WHERE vec_id % 100 = 0""",
    "knn_close": _knn("list_transform(embedding, lambda x: (x * 0.0001::DOUBLE)::FLOAT)"),
    "knn_odd_vectors": _knn(
        "CASE vec_id % 10 WHEN 0 THEN embedding[1:1] WHEN 1 THEN NULL"
        " WHEN 2 THEN list_concat(embedding[1:63], ['NaN'::FLOAT]) ELSE embedding END"
    ),
    "question_retrieval": f"{_RETRIEVAL} {_rounded('FROM hits')}",
    "retrieved_context": f"""{_RETRIEVAL}
SELECT query_id, rank, id, video_id, title, content FROM hits JOIN passages USING (id)""",
    "context_repeated_ids": f"""{_RETRIEVAL}
SELECT query_id, rank, id, video_id, title, content || {_quoted(LATER)} AS content
FROM hits JOIN passages USING (id)""",
    "context_cells_repeated": f"""{_retrieval(
        "CASE WHEN id IN (SELECT id FROM passages WHERE title = 'fr') THEN list_reverse(p.v) ELSE p.v END"
    )}
SELECT query_id, rank, id, video_id, title,
       CASE WHEN title = 'fr' THEN content || {_quoted(LATER)} ELSE content END AS content
FROM hits JOIN passages USING (id)""",
    "table_overwrite": """
SELECT doc_id, lang, source, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n_chars
FROM documents WHERE lang <> 'fr' OR n_chars > 500""",
    "table_upsert": """
SELECT doc_id, CASE WHEN lang = 'fr' AND n_chars < 300 THEN 'de' ELSE lang END AS lang, source,
       CASE WHEN lang = 'fr' AND n_chars > 500 THEN n_chars + 1 ELSE n_chars END AS n_chars
FROM documents
UNION ALL SELECT -1 - doc_id, lang, source, n_chars FROM documents WHERE lang = 'de'""",
    "table_by_catalog": "SELECT doc_id, lang, source, n_chars FROM documents",
    "rag_prompts": f"""{_RETRIEVAL}
SELECT query_id, any_value(b.text) AS input, {_PROMPT} AS prompt
FROM {_ANSWERABLE} GROUP BY query_id""",
    "rag_answers": f"""{_RETRIEVAL}
SELECT query_id, any_value(b.text) AS input, count(*) AS n_context,
       string_agg(id, ',' ORDER BY rank) AS context_ids,
       length({_PROMPT}) || ' characters' AS answer
FROM {_ANSWERABLE} GROUP BY query_id""",
    "frame_diff": f"{_excess(_LEFT, _RIGHT, 'left')} UNION ALL {_excess(_RIGHT, _LEFT, 'right')}",
    "keyed_diff": """
WITH other AS (
  SELECT doc_id, lang, source,
         CASE WHEN source = 'src1' AND lang = 'fr' THEN -n_chars ELSE n_chars END AS n_chars
  FROM documents),
shorter AS (SELECT * FROM other WHERE n_chars < 0 OR n_chars > 100)
SELECT *, 'left' AS side, 1::BIGINT AS copies
FROM (SELECT doc_id, lang, source, n_chars FROM documents EXCEPT ALL SELECT * FROM shorter)
UNION ALL
SELECT *, 'right', 1
FROM (SELECT * FROM shorter EXCEPT ALL SELECT doc_id, lang, source, n_chars FROM documents)""",
    "sorted_nulls_last": f"""
SELECT * FROM ({_WITH_NULLS})
ORDER BY lang NULLS LAST, source NULLS LAST, doc_id NULLS LAST""",
    "row_index": f"""
SELECT *, row_number() OVER (ORDER BY lang NULLS LAST, source NULLS LAST, doc_id NULLS LAST) - 1
       AS row_index
FROM ({_WITH_NULLS})""",
}
