"""The SQL twin of every registered query that plain SQL can express."""

from __future__ import annotations

from engram import schema
from engram.catalog import queries as q
from engram.catalog.fixtures import AS_OF, DIMENSION
from engram.functions import summaries
from engram.functions import text as tx
from engram.operators import ann, chats, lists

# The memory tables, as in fixtures.py.
MEMORIES = f"""
memories AS (
  SELECT d.doc_id AS id,
         coalesce(nullif(trim(regexp_extract(d.text, '^[^.!?\\n]*')), ''), d.source) AS heading,
         d.text AS summary, e.embedding AS embedding,
         make_timestamp((1704067200 + (d.doc_id * 104729) % 2592000) * 1000000) AS created_at,
         make_timestamp((1704067200 + (d.doc_id * 104729) % 2592000) * 1000000) AS updated_at,
         d.lang AS context, d.source AS source,
         CASE WHEN l.quality IS NULL THEN 0.5::DOUBLE
              ELSE (d.n_chars % 101)::DOUBLE / 100 END AS importance_score
  FROM documents d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
RAW_TAGS = """
raw_tags AS (
  SELECT doc_id AS memory_id, lang AS tag FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT user_id, event_type FROM events)"""
TAGS = RAW_TAGS + ",\ntags AS (SELECT DISTINCT memory_id, tag FROM raw_tags)"
METADATA = """
metadata AS (
  SELECT memory_id, key, value, created_at FROM (
    SELECT *, row_number() OVER (
             PARTITION BY memory_id, key ORDER BY created_at DESC, value DESC) AS n
    FROM (
      SELECT user_id AS memory_id, 'props' AS key, props AS value, ts AS created_at FROM events
      UNION ALL
      SELECT user_id, 'last_event', '"' || event_type || '"', ts FROM events
      UNION ALL
      SELECT doc_id, 'project', '"' || source || '"', TIMESTAMP '2024-01-01' FROM documents))
  WHERE n = 1)"""

QUERY = f"list_transform(range(1, {DIMENSION + 1}), lambda i: sin(i))"
LIMIT, THRESHOLD = schema.SEARCH_LIMIT, schema.SEARCH_THRESHOLD


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') AS {column.split('.')[-1]}"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    )


STOPS = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


def stem(w: str) -> str:
    s = rf"regexp_replace(regexp_replace({w}, '(ss|i)es$', '\1'), '([^s])s$', '\1')"

    def mend(x: str) -> str:
        return (
            f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' "
            f"WHEN regexp_matches({x}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') "
            f"THEN regexp_replace({x}, '.$', '') ELSE {x} END"
        )

    e = (
        f"CASE WHEN ends_with({s}, 'eed') "
        rf"THEN regexp_replace({s}, '([aeiouy][^aeiouy].*)eed$', '\1ee') "
        f"WHEN regexp_matches({s}, '[aeiouy].*ed$') "
        f"THEN {mend(f'''regexp_replace({s}, 'ed$', '')''')} "
        f"WHEN regexp_matches({s}, '[aeiouy].*ing$') "
        f"THEN {mend(f'''regexp_replace({s}, 'ing$', '')''')} ELSE {s} END"
    )
    return (
        f"CASE WHEN length({w}) <= 2 THEN {w} "
        rf"ELSE regexp_replace({e}, '([aeiouy].*)y$', '\1i') END"
    )


def terms_of(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(list_filter({words(x)}, "
        f"lambda w: w NOT IN {STOPS}), lambda w: {stem('w')})))"
    )


def grams(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({words(x)}, lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def overlap(a: str, b: str) -> str:
    return (
        f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / "
        f"nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"
    )


TERMS = f"""
field_terms AS (
  SELECT id, field, {stem('word')} AS term
  FROM (SELECT id, field, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word
        FROM (SELECT id, 'a' AS field, heading AS text FROM memories
              UNION ALL SELECT id, 'b', summary FROM memories
              UNION ALL SELECT id, 'c', coalesce(context, '') FROM memories))
  WHERE word <> '' AND word NOT IN {STOPS}),
weighted AS (
  SELECT id, term, count(*) FILTER (field = 'a') AS tf_a, count(*) FILTER (field = 'b') AS tf_b,
         count(*) FILTER (field = 'c') AS tf_c
  FROM field_terms GROUP BY id, term)"""
WEIGHT = (
    f"{tx.HEADING_WEIGHT}::DOUBLE * tf_a + {tx.SUMMARY_WEIGHT}::DOUBLE * tf_b"
    f" + {tx.CONTEXT_WEIGHT}::DOUBLE * tf_c"
)
TEXT_SETS = f"""
asked AS (SELECT item_id AS query_id, {terms_of('text')} AS terms FROM benchmark),
sets AS (SELECT terms, min(query_id) AS query_id FROM asked WHERE len(terms) > 0 GROUP BY terms),
set_terms AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM sets),
matched AS (
  SELECT s.query_id, w.id, round(sum({WEIGHT}) / any_value(s.n_terms), 6) AS rank
  FROM set_terms s JOIN weighted w ON w.term = s.term
  GROUP BY s.query_id, w.id HAVING count(*) = any_value(s.n_terms))"""
ONE_TEXT = f"""
wanted AS (SELECT unnest(terms) AS term, len(terms) AS n_terms
           FROM (SELECT {terms_of("'" + q.TEXT_QUERY + "'")} AS terms)),
found AS (
  SELECT w.id, round(sum({WEIGHT}) / any_value(n_terms), 6) AS rank
  FROM wanted t JOIN weighted w ON w.term = t.term
  GROUP BY w.id HAVING count(*) = any_value(n_terms))"""

DOCUMENT_ROWS = r"""
document_rows AS (
  SELECT sha256(concat_ws(chr(1), doc_id::VARCHAR, text)) AS id, source,
         CASE WHEN trim(regexp_extract(text, '^[^.!?\n]*')) = '' THEN 'heading is required'
              WHEN text = '' THEN 'summary is required'
              WHEN n_chars / 2000.0 > 1 THEN 'importance_score must be between 0 and 1'
         END AS error
  FROM documents)"""

TOPICS = """
topics AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY p)::FLOAT[] AS embedding
  FROM (SELECT label, p, round(avg(v), 6) AS m
        FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p
              FROM embeddings) GROUP BY label, p)
  GROUP BY label)"""


def best(name: str, pairs: str, limit: int, threshold: float) -> str:
    """CTE of the best hits per query from (query_id, id, similarity) pairs."""
    return f"""
{name} AS (
  SELECT query_id, id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM ({pairs}) WHERE similarity >= {threshold}
  QUALIFY rank <= {limit})"""


SELF_PAIRS = f"""SELECT a.vec_id AS query_id, b.vec_id AS id,
  {cosine('a.embedding', 'b.embedding')} AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
DUPLICATES = best("hits", SELF_PAIRS, schema.DUPLICATE_LIMIT, schema.DUPLICATE_THRESHOLD)
EXACT = best("exact", SELF_PAIRS, LIMIT, THRESHOLD)
IVF = f"""
centroids AS (
  SELECT label AS list_id, list(m ORDER BY p) AS centroid
  FROM (SELECT label, p, round(avg(v), 6) AS m
        FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p
              FROM embeddings) GROUP BY label, p)
  GROUP BY label),
nearby AS (
  SELECT vec_id, embedding, list_id, row_number() OVER (
           PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], centroid) DESC,
           list_id) AS place
  FROM embeddings, centroids)"""
IVF_PAIRS = f"""SELECT a.vec_id AS query_id, b.vec_id AS id,
  {cosine('a.embedding', 'b.embedding')} AS similarity
  FROM nearby a JOIN nearby b ON a.list_id = b.list_id AND b.place = 1
    AND a.place <= {q.IVF_PROBES} AND a.vec_id <> b.vec_id"""
IVF_HITS = IVF + "," + best("hits", IVF_PAIRS, LIMIT, THRESHOLD)
LSH = f"""
planes AS (
  SELECT t, b, list(CASE WHEN substr(md5(t || '-' || b || '-' || d), 1, 1) < '8'
                         THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane
  FROM range({q.LSH_TABLES}) x(t), range({q.LSH_BITS}) y(b), range({DIMENSION}) z(d)
  GROUP BY t, b),
buckets AS (
  SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], plane) >= 0
                             THEN 1 << b::INT ELSE 0 END) AS bucket
  FROM embeddings, planes GROUP BY vec_id, t),
met AS (
  SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS id
  FROM buckets a JOIN buckets b ON a.t = b.t AND a.bucket = b.bucket AND a.vec_id <> b.vec_id)"""
LSH_PAIRS = f"""SELECT query_id, id, {cosine('a.embedding', 'b.embedding')} AS similarity
  FROM met JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id"""
LSH_HITS = LSH + "," + best("hits", LSH_PAIRS, LIMIT, THRESHOLD)
HITS = "SELECT query_id, id, similarity, rank FROM hits"
RECALL = """SELECT count(*) AS exact_hits, count(h.id) AS found_hits,
  round(count(h.id) / count(*), 6) AS recall
  FROM exact e LEFT JOIN hits h ON h.query_id = e.query_id AND h.id = e.id"""

HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
SAMPLED = f"sampled AS (SELECT vec_id FROM embeddings ORDER BY {HASH.format('vec_id')}, vec_id LIMIT {lists.SAMPLE})"


def disc(values: str, column: str) -> str:
    """The least value that TARGET of the values do not exceed."""
    return f"""(SELECT min({column}) AS p FROM (
      SELECT {column}, cume_dist() OVER (ORDER BY {column}) AS share FROM {values})
      WHERE share >= {lists.TARGET})"""


def closest(rows: str, centroids: str, part: str = "") -> str:
    same = f" AND v.{part} = l.{part}" if part else ""
    return f"""SELECT v.id, v.v, v.h, l.list_id{f', l.{part}' if part else ''}
  FROM {rows} v JOIN {centroids} l ON true{same}
  QUALIFY row_number() OVER (PARTITION BY v.id
    ORDER BY round(list_cosine_similarity(v.v, l.c), 6) DESC, l.list_id) = 1"""


def means(members: str, part: str = "") -> str:
    key = "list_id" + (f", {part}" if part else "")
    return f"""SELECT {key}, list(m ORDER BY p) AS c
  FROM (SELECT {key}, p, round(avg(x), {lists.CENTROID_DECIMALS}) AS m
        FROM (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {members})
        GROUP BY {key}, p) GROUP BY {key}"""


LISTS = f"""
vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {HASH.format('vec_id')} AS h FROM embeddings),
sizes AS (SELECT count(*) AS n,
  greatest({lists.LEAST_ROWS}, floor(sqrt(count(*)))::BIGINT // {lists.ROOT_SHARE}) AS per FROM vecs),
tops0 AS (SELECT row_number() OVER (ORDER BY h, id) AS list_id, v AS c FROM vecs
  QUALIFY list_id <= (SELECT ceil(sqrt(n / per)) FROM sizes)),
m0 AS ({closest('vecs', 'tops0')}),
tops1 AS ({means('m0')}),
m1 AS ({closest('vecs', 'tops1')}),
parted AS (SELECT id, v, h, list_id AS part FROM m1),
lists0 AS (
  SELECT part, c, row_number() OVER (ORDER BY part, name) AS list_id FROM (
    SELECT part, id::VARCHAR AS name, v AS c FROM parted, sizes WHERE h < floor(4294967296 / per)
    UNION ALL SELECT list_id, '', c FROM tops1)),
m2 AS ({closest('parted', 'lists0', 'part')}),
lists1 AS ({means('m2', 'part')}),
m3 AS ({closest('parted', 'lists1', 'part')})"""
LISTS_HITS = f"""
ranks AS (SELECT v.id AS query_id, l.list_id, row_number() OVER (PARTITION BY v.id
    ORDER BY round(list_cosine_similarity(v.v, l.c), 6) DESC, l.list_id) AS rank FROM vecs v, lists1 l),
{SAMPLED},
places_at AS (SELECT r.rank FROM exact e JOIN sampled s ON s.vec_id = e.query_id JOIN m3 m ON m.id = e.id
  JOIN ranks r ON r.query_id = e.query_id AND r.list_id = m.list_id),
probes AS {disc('places_at', 'rank')},""" + best("hits", f"""
  SELECT r.query_id, m.id, {cosine('q.v', 'm.v')} AS similarity
  FROM ranks r JOIN m3 m ON r.list_id = m.list_id JOIN vecs q ON q.id = r.query_id, probes
  WHERE r.rank <= p AND m.id <> r.query_id""", LIMIT, THRESHOLD)
BUCKETS = f"""
sizes AS (SELECT greatest(1, floor(log2(count(*) / {ann.ROWS_PER_BUCKET})))::INT AS bits FROM embeddings),
planes AS (
  SELECT t, b, list(CASE WHEN substr(md5(t || '-' || b || '-' || d), 1, 1) < '8'
                         THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane
  FROM range({q.PROBED_TABLES}) x(t), range(30) y(b), range({DIMENSION}) z(d), sizes WHERE b < bits
  GROUP BY t, b),
margins AS (SELECT vec_id, t, b, list_dot_product(embedding::DOUBLE[], plane) AS m FROM embeddings, planes),
own AS (SELECT vec_id, t, sum(CASE WHEN m >= 0 THEN 1 << b::INT ELSE 0 END)::BIGINT AS bucket
  FROM margins GROUP BY vec_id, t),
near AS (
  SELECT vec_id, t, bucket, row_number() OVER (PARTITION BY vec_id, t ORDER BY cost, bucket) AS probe
  FROM (SELECT vec_id, t, x.bucket, sum(CASE WHEN (m >= 0) <> ((x.bucket >> b::INT) & 1 = 1) THEN abs(m) ELSE 0 END) AS cost
        FROM margins, sizes, range(1 << 16) x(bucket) WHERE x.bucket < (1 << bits) GROUP BY vec_id, t, x.bucket))"""
BUCKETS_HITS = f"""
{SAMPLED},
places_at AS (SELECT e.query_id, e.id, min(n.probe) AS probe FROM exact e JOIN sampled s ON s.vec_id = e.query_id
  JOIN own o ON o.vec_id = e.id JOIN near n ON n.vec_id = e.query_id AND n.t = o.t AND n.bucket = o.bucket
  GROUP BY e.query_id, e.id),
probes AS {disc('places_at', 'probe')},
met_pairs AS (SELECT DISTINCT n.vec_id AS query_id, o.vec_id AS id FROM near n JOIN own o
  ON n.t = o.t AND n.bucket = o.bucket AND n.vec_id <> o.vec_id, probes WHERE n.probe <= p),""" + best("hits", f"""
  SELECT query_id, id, {cosine('a.embedding', 'b.embedding')} AS similarity
  FROM met_pairs JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id""", LIMIT, THRESHOLD)
RECALL_AND_PAIRS = """SELECT *, round(pairs_met / pairs, 6) AS share_met FROM (
  SELECT count(*) AS exact_hits, count(h.id) AS found_hits, round(count(h.id) / count(*), 6) AS recall
  FROM exact e LEFT JOIN hits h ON h.query_id = e.query_id AND h.id = e.id), met,
  (SELECT count(*) * count(*) AS pairs FROM embeddings)"""

LINES = """
lines AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations),
logs AS (
  SELECT conv_id, 0::BIGINT AS part, count(*) AS n_turns,
         string_agg(line, chr(10) ORDER BY turn) AS chat_text
  FROM lines GROUP BY conv_id)"""
def word_vectors(name: str, rows: str) -> str:
    """Weights (id, bucket, v) of the hashing embedder over rows (id, text)."""
    return f"""
{name}_words AS (
  SELECT id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE w END) AS word FROM (
    SELECT id, w, list_filter(w, lambda x: x NOT IN {STOPS}) AS kept FROM (
      SELECT id, {words("coalesce(text, '')")} AS w FROM ({rows})))),
{name}_counts AS (
  SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % {chats.EMBEDDING_DIMENSION} AS bucket,
         count(*)::DOUBLE AS n FROM {name}_words GROUP BY ALL),
{name} AS (
  SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v
  FROM {name}_counts)"""


SUMMARIES = f"""
sentences AS (
  SELECT conv_id, turn, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no
  FROM (SELECT conv_id, turn, list_filter(list_transform(
          regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: {strip('x')}),
          lambda x: x <> '') AS s FROM conversations)),
occurrences AS (
  SELECT conv_id, turn, sentence_no, {stem('word')} AS term FROM (
    SELECT conv_id, turn, sentence_no,
           unnest(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}]+')) AS word
    FROM sentences) WHERE word <> '' AND word NOT IN {STOPS}),
idfs AS (
  SELECT term, ln((1 + (SELECT count(DISTINCT conv_id) FROM conversations))::DOUBLE
                  / (1 + count(DISTINCT conv_id))) AS idf
  FROM occurrences GROUP BY term),
places AS (
  SELECT *, row_number() OVER (
           PARTITION BY conv_id ORDER BY score DESC, turn, sentence_no) AS place
  FROM (SELECT conv_id, turn, sentence_no, round(sum(idf) / sqrt(count(*)), 6) AS score
        FROM occurrences JOIN idfs USING (term) GROUP BY conv_id, turn, sentence_no)),
chosen AS (
  SELECT conv_id, arg_min(sentence, place) AS best,
         string_agg(sentence, ' ' ORDER BY turn, sentence_no) AS summary
  FROM places JOIN sentences USING (conv_id, turn, sentence_no)
  WHERE place <= {chats.SUMMARY_SENTENCES} GROUP BY conv_id),
summaries AS (
  SELECT t.conv_id, t.n_turns,
    coalesce(array_to_string(list_slice(regexp_split_to_array(best, '\\s+'), 1,
             {schema.HEADING_WORDS}), ' '), '{summaries.FALLBACK_HEADING}') AS heading,
    coalesce(summary, 'Chat log with ' || t.n_turns || ' messages.') AS summary
  FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) t
  LEFT JOIN chosen USING (conv_id))"""

_before, _rest = summaries.PROMPT_TEMPLATE.replace("'", "''").split("{context}")
_between, _after = _rest.split("{chat}")

TWINS: dict[str, str] = {
    "scan_memories": f"""WITH {MEMORIES} SELECT id, heading, summary, {iso('created_at')},
      {iso('updated_at')}, context, source, importance_score,
      len(embedding) AS dimension FROM memories""",
    "build_memories": f"""WITH {MEMORIES} SELECT id, heading, summary, {iso('created_at')},
      {iso('updated_at')}, context, source, importance_score,
      embedding IS NULL AS no_vector FROM memories""",
    "store_memories": f"""WITH {DOCUMENT_ROWS}
      SELECT id AS memory_id FROM document_rows WHERE error IS NULL""",
    "validate_memories": f"WITH {DOCUMENT_ROWS} SELECT id, error FROM document_rows",
    "tag_explode": """SELECT doc_id AS memory_id, unnest(list_filter([lang, source,
      CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END], lambda x: x IS NOT NULL)) AS tag
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "metadata_explode": """SELECT doc_id AS memory_id, 'lang' AS key, to_json(lang)::VARCHAR AS value
      FROM documents UNION ALL SELECT doc_id, 'project', to_json(source)::VARCHAR FROM documents""",
    "tags_dedup": f"WITH {TAGS} SELECT memory_id, tag FROM tags",
    "metadata_latest": f"""WITH {METADATA}
      SELECT memory_id, key, value, {iso('created_at')} FROM metadata""",
    "upsert_memories": f"""WITH {MEMORIES},
      latest AS (
        SELECT user_id AS id, event_type AS heading, props AS summary, 'event' AS source,
               0.5::DOUBLE AS importance_score, ts AS created_at, ts AS updated_at FROM events
        QUALIFY row_number() OVER (
          PARTITION BY user_id ORDER BY ts DESC, event_type DESC, props DESC) = 1
        UNION ALL
        SELECT item_id + {q.INSERTED_FROM}, 'item ' || item_id, text, 'benchmark', 0.5,
               TIMESTAMP '2024-01-31', TIMESTAMP '2024-01-31' FROM benchmark),
      after AS (
        SELECT id, heading, summary, source, importance_score, created_at, updated_at
        FROM memories WHERE id NOT IN (SELECT id FROM latest)
        UNION ALL
        SELECT l.id, l.heading, l.summary, l.source, l.importance_score,
               coalesce(m.created_at, l.created_at),
               CASE WHEN m.id IS NULL THEN l.updated_at ELSE TIMESTAMP '{AS_OF}' END
        FROM latest l LEFT JOIN memories m ON m.id = l.id)
      SELECT id, heading, summary, source, importance_score, {iso('created_at')},
             {iso('updated_at')} FROM after""",
    "delete_memories": f"""WITH {MEMORIES}, {TAGS}, {METADATA},
      toxic AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1),
      remaining AS (
        SELECT 'memory' AS kind, id AS memory_id FROM memories
          WHERE id NOT IN (SELECT id FROM toxic)
        UNION ALL SELECT 'tag', memory_id FROM tags WHERE memory_id NOT IN (SELECT id FROM toxic)
        UNION ALL SELECT 'metadata', memory_id FROM metadata
          WHERE memory_id NOT IN (SELECT id FROM toxic)
        UNION ALL SELECT 'deleted', id FROM toxic WHERE id IN (SELECT id FROM memories))
      SELECT kind, memory_id, count(*) AS n FROM remaining GROUP BY kind, memory_id""",
    "get_by_id": f"""WITH {MEMORIES} SELECT id, heading, summary, {iso('created_at')}
      FROM memories WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error')""",
    "fk_check": """SELECT event_id AS memory_id, event_type AS tag FROM events
      WHERE event_id NOT IN (SELECT doc_id FROM documents)""",
    "result_shape": f"""WITH {MEMORIES}
      SELECT id, heading, summary, {iso('created_at')} FROM memories""",
    "filter_similarity": f"""SELECT id, similarity FROM (
      SELECT vec_id AS id, {cosine('embedding', QUERY)} AS similarity FROM embeddings)
      WHERE similarity >= {THRESHOLD}""",
    "filter_importance": f"""WITH {MEMORIES} SELECT id, importance_score FROM memories
      WHERE importance_score >= {q.MIN_IMPORTANCE}""",
    "filter_source": f"""WITH {MEMORIES} SELECT id, source FROM memories
      WHERE source = '{q.SOURCE}'""",
    "filter_dates": f"""WITH {MEMORIES} SELECT id, {iso('created_at')} FROM memories
      WHERE memories.created_at >= TIMESTAMP '{q.DATE_FROM}'
        AND memories.created_at <= TIMESTAMP '{q.DATE_TO}'""",
    "filter_since": f"""WITH {MEMORIES} SELECT id, {iso('created_at')} FROM memories
      WHERE memories.created_at >= TIMESTAMP '{q.SINCE}'""",
    "filter_heading_like": f"""WITH {MEMORIES} SELECT id, heading FROM memories
      WHERE {' OR '.join(f"heading LIKE '%{h}%'" for h in q.HEADINGS)}""",
    "filter_metadata": f"""WITH {MEMORIES}, {METADATA} SELECT id, source FROM memories
      WHERE id IN (SELECT memory_id FROM metadata WHERE key = 'last_event'
                   AND json_extract_string(value, '$') = 'error')""",
    "filter_project": f"""WITH {MEMORIES}, {METADATA} SELECT id, source FROM memories
      WHERE id IN (SELECT memory_id FROM metadata WHERE key = 'project'
                   AND json_extract_string(value, '$') = '{q.PROJECT}')""",
    "filter_tags_any": f"""WITH {MEMORIES}, {TAGS} SELECT id, context FROM memories
      WHERE id IN (SELECT memory_id FROM tags WHERE tag IN {tuple(q.TAGS)})""",
    "join_tags_left": f"""WITH {MEMORIES}, {TAGS} SELECT m.id, m.source, t.tag
      FROM memories m LEFT JOIN tags t ON t.memory_id = m.id""",
    "semi_tag": f"""WITH {MEMORIES}, {TAGS} SELECT id, context FROM memories
      WHERE id IN (SELECT memory_id FROM tags WHERE tag = '{q.TAG}')""",
    "query_cross_memories": f"""WITH {TOPICS}
      SELECT query_id, count(*) AS met, max(similarity) AS closest FROM (
        SELECT t.query_id, {cosine('t.embedding', 'e.embedding')} AS similarity
        FROM topics t, embeddings e) WHERE similarity >= {THRESHOLD} GROUP BY query_id""",
    "near_dup_check": f"WITH {DUPLICATES} {HITS}",
    "near_dup_chats": f"""WITH
      {word_vectors('stored', 'SELECT doc_id AS id, text FROM documents')},
      {word_vectors('asked', """SELECT conv_id AS id, string_agg(line, ' ' ORDER BY turn) AS text
        FROM (SELECT conv_id, turn, role || ': ' || text AS line,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
        WHERE n <= 3 GROUP BY conv_id""")},
      stored_norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM stored GROUP BY id),
      asked_norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM asked GROUP BY id),
      dots AS (SELECT a.id AS query_id, s.id, sum(a.v * s.v) AS dot
        FROM asked a JOIN stored s USING (bucket) GROUP BY a.id, s.id),
      hits AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
        FROM (SELECT d.query_id, d.id, round(d.dot / (a.norm * s.norm), 6) AS similarity
              FROM dots d JOIN asked_norms a ON a.id = d.query_id
              JOIN stored_norms s ON s.id = d.id)
        WHERE similarity >= {schema.DUPLICATE_THRESHOLD})
      {HITS} WHERE rank <= {schema.DUPLICATE_LIMIT}""",
    "embed_texts": f"""WITH {word_vectors('vectors', 'SELECT doc_id AS id, text FROM documents')},
      joined AS (SELECT id, string_agg(bucket || ':' || floor(v * 10000 + 0.501)::BIGINT, ' '
                   ORDER BY bucket) AS weights FROM vectors GROUP BY id)
      SELECT d.doc_id AS id, CASE WHEN coalesce(d.text, '') = ''
          THEN 'text is required and cannot be empty'
          WHEN j.id IS NULL THEN 'text has no weighted terms' END AS embed_error,
        CASE WHEN j.id IS NOT NULL THEN {chats.EMBEDDING_DIMENSION}::BIGINT END AS dimension,
        j.weights
      FROM documents d LEFT JOIN joined j ON j.id = d.doc_id""",
    "count_total": f"WITH {MEMORIES} SELECT count(*) AS total_memories FROM memories",
    "daily_activity": f"""WITH {MEMORIES}
      SELECT created_at::DATE::VARCHAR AS day, count(*) AS memories FROM memories
      WHERE created_at >= DATE '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""",
    "store_stats": f"""WITH {MEMORIES}
      SELECT 'total_memories' AS metric, NULL::VARCHAR AS day, count(*) AS value FROM memories
      UNION ALL SELECT 'recent_activity', created_at::DATE::VARCHAR, count(*) FROM memories
      WHERE created_at >= DATE '{AS_OF}' - INTERVAL 7 DAY GROUP BY 2""",
    "memory_stats": f"""WITH {MEMORIES}, {TAGS}
      SELECT count(*) AS total_memories,
        count(*) FILTER (created_at >= DATE '{AS_OF}' - INTERVAL 7 DAY) AS recent_memories,
        count(*) FILTER (created_at >= DATE '{AS_OF}' - INTERVAL 30 DAY) AS monthly_memories,
        round(avg(importance_score), 6) AS avg_importance,
        count(DISTINCT source) AS unique_sources, count(DISTINCT tag) AS unique_tags
      FROM memories m LEFT JOIN tags t ON t.memory_id = m.id""",
    "memory_stats_per_memory": f"""WITH {MEMORIES}, {TAGS}
      SELECT count(*) AS total_memories,
        count(*) FILTER (created_at >= DATE '{AS_OF}' - INTERVAL 7 DAY) AS recent_memories,
        count(*) FILTER (created_at >= DATE '{AS_OF}' - INTERVAL 30 DAY) AS monthly_memories,
        round(avg(importance_score), 6) AS avg_importance,
        count(DISTINCT source) AS unique_sources,
        (SELECT count(DISTINCT tag) FROM tags
         WHERE memory_id IN (SELECT id FROM memories)) AS unique_tags FROM memories""",
    "tags_array": f"""WITH {TAGS} SELECT memory_id AS id, string_agg(tag, ',' ORDER BY tag) AS tags
      FROM tags GROUP BY memory_id""",
    "memories_with_tags": f"""WITH {MEMORIES}, {TAGS}
      SELECT m.id, any_value(heading) AS heading, any_value(summary) AS summary,
        any_value(context) AS context, any_value(source) AS source,
        any_value(importance_score) AS importance_score,
        strftime(any_value(created_at), '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
        strftime(any_value(updated_at), '%Y-%m-%dT%H:%M:%S.%f') AS updated_at,
        coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags
      FROM memories m LEFT JOIN tags t ON t.memory_id = m.id GROUP BY m.id""",
    "total_found": f"""WITH {DUPLICATES}
      SELECT e.vec_id AS query_id, count(h.id) AS total_found
      FROM embeddings e LEFT JOIN hits h ON h.query_id = e.vec_id GROUP BY e.vec_id""",
    "status_report": f"""WITH {MEMORIES}, {TAGS}, {METADATA}
      SELECT 'Total memories' AS info, count(*) AS value FROM memories
      UNION ALL SELECT 'Total tags', count(*) FROM tags
      UNION ALL SELECT 'Total metadata', count(*) FROM metadata""",
    "recent_memories": f"""WITH {MEMORIES}
      SELECT id, heading, summary, {iso('created_at')}, 0.0::DOUBLE AS similarity FROM memories
      ORDER BY memories.created_at DESC, id LIMIT {schema.RECENT_LIMIT}""",
    "topk_similar": f"""WITH {MEMORIES} SELECT id, heading, summary, {iso('created_at')}, similarity
      FROM (SELECT *, {cosine('embedding', QUERY)} AS similarity FROM memories)
      WHERE similarity >= {THRESHOLD}
      ORDER BY similarity DESC, id LIMIT {schema.STORE_SEARCH_LIMIT}""",
    "topk_similar_batch": "WITH " + TOPICS + "," + best(
        "hits",
        f"""SELECT t.query_id, e.vec_id AS id,
        {cosine('t.embedding', 'e.embedding')} AS similarity FROM topics t, embeddings e""",
        LIMIT, THRESHOLD,
    ) + HITS,
    "order_rank_recency": f"""WITH {MEMORIES}
      SELECT id, round(importance_score, 1) AS rank, {iso('created_at')} FROM memories
      ORDER BY rank DESC, memories.created_at DESC, id LIMIT {LIMIT}""",
    "preview": f"""WITH {MEMORIES}
      SELECT id, substr(heading, 1, {schema.PREVIEW_HEADING_CHARS}) AS heading,
        substr(summary, 1, {schema.PREVIEW_SUMMARY_CHARS}) AS summary, similarity
      FROM (SELECT *, {cosine('embedding', QUERY)} AS similarity FROM memories)
      WHERE similarity >= {THRESHOLD}
      ORDER BY similarity DESC, id LIMIT {schema.PREVIEW_ROWS}""",
    "cosine_similarity": f"""SELECT vec_id AS id, {cosine('embedding', QUERY)} AS similarity
      FROM embeddings""",
    "cosine_distance": f"""SELECT vec_id AS id,
      round(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY}), 6) AS distance
      FROM embeddings""",
    "l2_normalize": """WITH scaled AS (
        SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v
        FROM embeddings),
      normed AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM scaled)
      SELECT id, round(n, 6) AS norm, round(list_max(list_transform(v, lambda x: x / n)), 6)
        AS largest, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6)
        AS unit_norm FROM normed""",
    "vector_dim": "SELECT vec_id AS id, len(embedding) AS dim FROM embeddings",
    "zero_vector": f"""WITH padded AS (
        SELECT vec_id AS id, list_concat(embedding::DOUBLE[], list_transform(
          range({chats.EMBEDDING_DIMENSION} - len(embedding)), lambda i: 0.0::DOUBLE)) AS v
        FROM embeddings)
      SELECT id, len(v) AS dim, round(sqrt(list_dot_product(v, v)), 6) AS norm,
        {chats.EMBEDDING_DIMENSION}::BIGINT AS zero_dim FROM padded""",
    "tokenize": f"""SELECT doc_id AS id, len({words('text')}) AS n_words,
      array_to_string({words('text')}, ' ') AS words FROM documents""",
    "weighted_terms": f"WITH {MEMORIES}, {TERMS} SELECT id, term, tf_a, tf_b, tf_c FROM weighted",
    "plain_query": f"""SELECT item_id AS query_id,
      array_to_string({terms_of('text')}, ' ') AS terms FROM benchmark""",
    "text_match": f"WITH {MEMORIES}, {TERMS}, {TEXT_SETS} SELECT query_id, id FROM matched",
    "text_rank": f"WITH {MEMORIES}, {TERMS}, {TEXT_SETS} SELECT query_id, id, rank FROM matched",
    "trigrams": f"""SELECT doc_id AS id,
      array_to_string(list_sort({grams('text')}), '|') AS grams FROM documents""",
    "trigram_similarity": f"""WITH {MEMORIES} SELECT id, round({overlap('a', 'b')}, 6) AS similarity
      FROM (SELECT id, {grams('heading')} AS a, {grams('summary')} AS b FROM memories)""",
    "trigram_search": f"""WITH {MEMORIES},
      scored AS (
        SELECT id, heading, round(greatest({overlap('a', 'c')}, {overlap('b', 'c')}), 6)
          AS similarity
        FROM (SELECT id, heading, {grams('heading')} AS a, {grams('summary')} AS b,
                     {grams(f"'{q.FUZZY_QUERY}'")} AS c FROM memories))
      SELECT id, heading, similarity FROM scored WHERE similarity >= {tx.TRIGRAM_THRESHOLD}
      ORDER BY similarity DESC, id LIMIT {LIMIT}""",
    "chat_text": f"WITH {LINES} SELECT conv_id, part, n_turns, chat_text FROM logs",
    "chat_parts": f"""WITH {LINES}
      SELECT conv_id, part, count(*) AS n_turns,
             string_agg(line, chr(10) ORDER BY turn) AS chat_text
      FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)
                      // {q.TURNS_PER_PART} AS part FROM lines)
      GROUP BY conv_id, part""",
    "first_turns": f"""WITH {LINES}
      SELECT conv_id, string_agg(line, ' ' ORDER BY turn) AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM lines)
      WHERE n <= 3 GROUP BY conv_id""",
    "embed_text_input": f"""WITH {MEMORIES}
      SELECT id, heading || chr(10) || chr(10) || summary AS text FROM memories""",
    "prompt_build": f"""WITH {LINES}
      SELECT conv_id, part, '{_before}' || 'conversation ' || conv_id || '{_between}' || chat_text
        || '{_after}' AS prompt FROM logs""",
    "parse_summary": f"""WITH responses AS (
        SELECT doc_id AS id, CASE lang
          WHEN 'en' THEN 'Heading: ' || source || chr(10) || 'Summary: not kept' || chr(10) || text
          WHEN 'fr' THEN '  1. HEADING:' || chr(10) || chr(10) || text
          WHEN 'de' THEN text || chr(10) || '2. Summary:' || chr(10) || chr(10) || ' ' || source
          ELSE text END AS response FROM documents),
      numbered AS (
        SELECT id, response, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n
        FROM (SELECT id, response, string_split({strip('response')}, chr(10)) AS ls
              FROM responses)),
      kinds AS (
        SELECT *, {strip('raw')} AS line,
          CASE WHEN regexp_matches(lower({strip('raw')}), '^(1\\. )?heading:') THEN 'H'
               WHEN regexp_matches(lower({strip('raw')}), '^(2\\. )?summary:') THEN 'S' END AS kind
        FROM numbered),
      placed AS (
        SELECT *, last_value(kind IGNORE NULLS) OVER (
            PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part,
          max(CASE WHEN kind = 'H' THEN n END) OVER (PARTITION BY id) AS h
        FROM kinds)
      SELECT id,
        coalesce(
          nullif(max(CASE WHEN n = h THEN {strip("substr(line, strpos(line, ':') + 1)")} END), ''),
          arg_min(line, n) FILTER (kind IS NULL AND part = 'H' AND n > h AND line <> ''),
          '{summaries.DEFAULT_HEADING}') AS heading,
        coalesce(
          string_agg(line, chr(10) ORDER BY n) FILTER (kind IS NULL AND part = 'S' AND line <> ''),
          any_value(response)) AS summary
      FROM placed GROUP BY id""",
    "fallback_summary": f"""SELECT conv_id, '{summaries.FALLBACK_HEADING}' AS heading,
      'Chat log with ' || count(*) || ' messages.' AS summary
      FROM conversations GROUP BY conv_id""",
    "json_value": """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
      to_json(event_type)::VARCHAR AS as_json, event_type AS from_json FROM events""",
    "date_functions": """SELECT event_id, ts::DATE::VARCHAR AS day,
      ts >= TIMESTAMP '2024-01-29' AS recent,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM events""",
    "string_functions": f"""SELECT conv_id, turn, lower({strip("role || ': ' || text")}) AS line,
      starts_with(lower(role || ': '), 'user:') AS from_user, {strip('text')} AS said
      FROM conversations""",
    "memory_id": """SELECT doc_id,
      sha256(concat_ws(chr(1), doc_id::VARCHAR, source, text)) AS memory_id FROM documents""",
    "search_semantic": f"""WITH {MEMORIES}, {TAGS},
      winners AS (
        SELECT * FROM (
          SELECT *, {cosine('embedding', QUERY)} AS similarity FROM memories
          WHERE importance_score >= {q.MIN_IMPORTANCE}
            AND created_at >= TIMESTAMP '{q.DATE_FROM}'
            AND created_at <= TIMESTAMP '2024-02-01 00:00:00'
            AND id IN (SELECT memory_id FROM tags WHERE tag = '{q.TAG}'))
        WHERE similarity >= {THRESHOLD} ORDER BY similarity DESC, id LIMIT {LIMIT})
      SELECT id AS memory_id, any_value(heading) AS heading, any_value(summary) AS summary,
        any_value(context) AS context, any_value(similarity) AS similarity,
        any_value(importance_score) AS importance_score,
        strftime(any_value(created_at), '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
        coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags
      FROM winners LEFT JOIN tags t ON t.memory_id = id GROUP BY id""",
    "search_text": f"""WITH {MEMORIES}, {TERMS}, {ONE_TEXT}
      SELECT m.id, heading, summary, context, rank,
        strftime(m.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
      FROM found f JOIN memories m ON m.id = f.id
      ORDER BY rank DESC, m.created_at DESC, m.id LIMIT {LIMIT}""",
    "search_text_batch": f"""WITH {MEMORIES}, {TERMS}, {TEXT_SETS},
      placed AS (
        SELECT a.query_id, x.id, x.rank, m.created_at, row_number() OVER (
            PARTITION BY a.query_id ORDER BY x.rank DESC, m.created_at DESC, x.id) AS place
        FROM asked a JOIN sets s ON s.terms = a.terms JOIN matched x ON x.query_id = s.query_id
        JOIN memories m ON m.id = x.id)
      SELECT query_id, id, rank, {iso('created_at')}, place FROM placed WHERE place <= 3""",
    "search_metadata": f"""WITH {MEMORIES}, {TAGS}
      SELECT id, heading, summary, {iso('created_at')} FROM memories
      WHERE memories.created_at <= TIMESTAMP '{q.DATE_TO}'
        AND id IN (SELECT memory_id FROM tags WHERE tag IN {tuple(q.TAGS)})
      ORDER BY memories.created_at DESC, id LIMIT {LIMIT}""",
    "search_hybrid": f"""WITH {MEMORIES}, {METADATA}
      SELECT id, heading, summary, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
        similarity
      FROM (SELECT *, {cosine('embedding', QUERY)} AS similarity FROM memories
            WHERE id IN (SELECT memory_id FROM metadata WHERE key = 'project'
                         AND json_extract_string(value, '$') = '{q.PROJECT}'))
      WHERE similarity >= 0.0 ORDER BY similarity DESC, id LIMIT {LIMIT}""",
    "fetch_context": f"""WITH {MEMORIES},
      ranked AS (
        SELECT e.vec_id AS query_id, m.id, m.heading, e.label,
          {cosine('e.embedding', 'm.embedding')} AS similarity
        FROM embeddings e, memories m WHERE e.label > 1 AND m.embedding IS NOT NULL),
      close AS (
        SELECT query_id, 'semantic' AS search_type_used, row_number() OVER (
            PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, id, similarity, heading,
          label FROM ranked),
      newest AS (
        SELECT id, heading, row_number() OVER (ORDER BY created_at DESC, id) AS rank
        FROM memories)
      SELECT query_id, search_type_used, rank, id, similarity, heading FROM close
      WHERE rank <= label + 1 AND similarity >= label / 40.0
      UNION ALL
      SELECT e.vec_id, 'recent', n.rank, n.id, 0.0, n.heading
      FROM embeddings e JOIN newest n ON n.rank <= e.label + 1 WHERE e.label <= 1""",
    "summarize_chats": f"""WITH {SUMMARIES}
      SELECT conv_id, n_turns, heading, summary FROM summaries""",
    "memorize_chats": f"""WITH {SUMMARIES}
      SELECT conv_id, sha256(concat_ws(chr(1), conv_id::VARCHAR, heading, summary)) AS memory_id,
        heading, summary, n_turns, {chats.EMBEDDING_DIMENSION}::BIGINT AS embedding_dimension,
        TRUE AS summarize_done, TRUE AS embed_done, TRUE AS store_done, NULL::VARCHAR AS error
      FROM summaries""",
    "ingest_conversations": f"""WITH {SUMMARIES},
      ids AS (SELECT conv_id, heading,
          sha256(concat_ws(chr(1), conv_id::VARCHAR, heading, summary)) AS memory_id
        FROM summaries)
      SELECT memory_id, 'memory' AS kind, heading AS value FROM ids
      UNION ALL SELECT DISTINCT memory_id, 'tag', role FROM ids JOIN conversations USING (conv_id)
      UNION ALL SELECT memory_id, 'last_turn', to_json(max(turn)::VARCHAR)::VARCHAR
        FROM ids JOIN conversations USING (conv_id) GROUP BY memory_id""",
    "ann_given_lists_build": f"""WITH {IVF}
      SELECT c.list_id, count(n.vec_id) AS n_vectors,
        round(sqrt(list_dot_product(any_value(c.centroid), any_value(c.centroid))), 5)
          AS centroid_norm
      FROM centroids c LEFT JOIN nearby n ON n.list_id = c.list_id AND n.place = 1
      GROUP BY c.list_id""",
    "ann_given_lists_search": f"WITH {IVF_HITS} {HITS}",
    "ann_one_bucket_search": f"WITH {LSH_HITS} {HITS}",
    "ann_ivf_build": f"""WITH {LISTS}
      SELECT l.list_id, count(m.id) AS n_vectors,
        round(sqrt(list_dot_product(any_value(l.c), any_value(l.c))), 5) AS centroid_norm
      FROM lists1 l LEFT JOIN m3 m USING (list_id) GROUP BY l.list_id""",
    "ann_ivf_search": f"WITH {EXACT}, {LISTS}, {LISTS_HITS} {HITS}",
    "ann_lsh_search": f"WITH {EXACT}, {BUCKETS}, {BUCKETS_HITS} {HITS}",
    "ann_ivf_recall": f"""WITH {EXACT}, {LISTS}, {LISTS_HITS},
      met AS (SELECT count(*) AS pairs_met FROM ranks r, m3 m, probes WHERE r.list_id = m.list_id AND r.rank <= p)
      {RECALL_AND_PAIRS}""",
    "ann_lsh_recall": f"""WITH {EXACT}, {BUCKETS}, {BUCKETS_HITS},
      met AS (SELECT count(*) AS pairs_met FROM near n, own o, probes
              WHERE n.t = o.t AND n.bucket = o.bucket AND n.probe <= p)
      {RECALL_AND_PAIRS}""",
    "stream_ingest": f"WITH {DOCUMENT_ROWS} SELECT id, error FROM document_rows",
    "stream_daily_activity": """SELECT ts::DATE::VARCHAR AS day, count(*) AS memories
      FROM events GROUP BY 1""",
    "stream_tag_dedup": "SELECT DISTINCT user_id AS memory_id, event_type AS tag FROM events",
}

GIVEN = f"""
given AS (
  SELECT s.*, e.embedding, sha256(concat_ws(chr(1), conv_id::VARCHAR, heading, summary)) AS memory_id,
    CASE WHEN e.vec_id IS NULL THEN 'no vector for this conv_id' END AS error
  FROM summaries s LEFT JOIN embeddings e ON e.vec_id + {q.FIRST_VECTOR_OF} = s.conv_id)"""
_counted = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in q.LETTERS) + "]"
TWINS |= {
    "store_batches": f"""WITH {DOCUMENT_ROWS}
      SELECT id, coalesce(error, 'in batch ' || CASE WHEN source < '{q.EARLY_SOURCES}' THEN 'a' ELSE 'b' END) AS what,
        CASE WHEN error IS NULL THEN 1 ELSE 2 END::BIGINT AS n FROM document_rows
      UNION ALL
      SELECT id, CASE WHEN source < '{q.EARLY_SOURCES}' THEN 'key is already stored' ELSE 'key repeats in the batch' END,
        CASE WHEN source < '{q.EARLY_SOURCES}' THEN 2 ELSE 1 END FROM document_rows WHERE error IS NULL""",
    "embed_provided": f"""WITH counted AS (
        SELECT doc_id AS id, CASE WHEN coalesce(text, '') = '' THEN 'text is required and cannot be empty'
            WHEN contains(text, '{q.REFUSED_LETTER}') THEN 'ValueError: a text holds {q.REFUSED_LETTER}' END AS error,
          list_transform({_counted}, lambda x: x::DOUBLE) AS v FROM documents),
      judged AS (
        SELECT id, v, list_dot_product(v, v) AS d,
          coalesce(error, CASE WHEN list_dot_product(v, v) = 0 THEN 'embedding is all zeros' END) AS embed_error FROM counted)
      SELECT id, embed_error, CASE WHEN embed_error IS NULL THEN {len(q.LETTERS)}::BIGINT END AS dimension,
        CASE WHEN embed_error IS NULL THEN array_to_string(list_transform(v,
          lambda x: floor((x / sqrt(d))::FLOAT::DOUBLE * 10000 + 0.501)::BIGINT::VARCHAR), ' ') END AS weights
      FROM judged""",
    "ingest_given_vectors": f"""WITH {SUMMARIES}, {GIVEN}
      SELECT memory_id, error, heading, CASE WHEN error IS NULL THEN {DIMENSION}::BIGINT END AS dimension,
        round(list_max(embedding)::DOUBLE, 6) AS largest FROM given""",
    "memory_pipeline": f"""WITH {SUMMARIES}, {GIVEN}
      SELECT conv_id, memory_id, heading, summary, n_turns,
        CASE WHEN error IS NULL THEN {DIMENSION}::BIGINT END AS embedding_dimension,
        TRUE AS summarize_done, NULL::VARCHAR AS summarize_error, error IS NULL AS embed_done, error AS embed_error,
        error IS NULL AS store_done, NULL::VARCHAR AS store_error, error FROM given
      UNION ALL
      SELECT item_id + {q.INSERTED_FROM}, NULL, NULL, NULL, 0, NULL, FALSE, '{summaries.EMPTY_LOG}', FALSE, NULL,
        FALSE, NULL, '{summaries.EMPTY_LOG}' FROM benchmark""",
    "summarize_provided": f"""WITH {LINES},
      last AS (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id),
      judged AS (SELECT *, contains(chat_text, '{q.REFUSED_PROMPT}') AS failed FROM logs JOIN last USING (conv_id))
      SELECT conv_id, n_turns, CASE WHEN failed THEN '{summaries.FALLBACK_HEADING}' ELSE role END AS heading,
        CASE WHEN failed THEN 'Chat log with ' || n_turns || ' messages.{summaries.FAILED_SUMMARY}ValueError: a prompt holds {q.REFUSED_PROMPT}'
          ELSE (length(chat_text) - length(replace(chat_text, chr(10), ''))) || ' breaks' END AS summary,
        NULL::VARCHAR AS summarize_error
      FROM judged""",
    "remember_conversations": f"""WITH {SUMMARIES}, {GIVEN},
      ok AS (SELECT * FROM given WHERE error IS NULL),
      notes AS (SELECT memory_id, max(role) AS value FROM ok JOIN conversations USING (conv_id) GROUP BY memory_id),
      stored AS (
        SELECT memory_id, 'memory' AS kind, heading AS value FROM ok JOIN notes n USING (memory_id) WHERE n.value = 'user'
        UNION ALL SELECT DISTINCT memory_id, 'tag', role FROM ok JOIN conversations USING (conv_id)
        UNION ALL SELECT memory_id, 'project', to_json(value)::VARCHAR FROM notes)
      SELECT *, strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%dT%H:%M:%S.%f') AS created_at, 'monday' AS batch_id FROM stored""",
}

# The same answers from stored indexes.
TWINS["text_index_search"] = TWINS["search_text"]
TWINS["trigram_index_search"] = TWINS["trigram_search"]
