"""SQL texts, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from courant.llm import licenses

# Components by repeated widening of (id, reached); {links} has both directions.
REACHED = """
reached AS (
  SELECT id, id AS other FROM {nodes}
  UNION
  SELECT r.id, l.b FROM reached r JOIN {links} l ON l.a = r.other
)"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: words[i:i + 4])) AS shingle
  FROM w WHERE len(words) > 0
), n AS (
  SELECT w.id, coalesce(c, 0) AS n FROM w LEFT JOIN (SELECT id, count(*) AS c FROM s GROUP BY id) USING (id)
), linked AS (
  SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.id <> y.id
  JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id
  GROUP BY x.id, y.id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), {REACHED.format(nodes="n", links="linked")}
SELECT n.id AS doc_id, n AS n_shingles, component_id, n.id = component_id AS kept
FROM n JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) USING (id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings
), linked AS (
  SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93
), {REACHED.format(nodes="v", links="linked")}
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component_id, v.id = component_id AS kept
FROM v JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) USING (id)
LEFT JOIN (SELECT a AS id, count(*) AS n FROM linked GROUP BY a) USING (id)"""


def _words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def license_scan() -> str:
    """Base phrases by place, and every window of words against every notice."""
    phrases = ", ".join(f"({_words(p.split(' '))}, '{label}')" for p, label in licenses.PHRASES.items())
    sets = {label: sorted(set(licenses.plain_words(t))) for label, t in licenses.NOTICES.items()}
    notices = ", ".join(f"('{label}', {_words(s)})" for label, s in sets.items())
    window, stride = licenses.WINDOW, licenses.STRIDE
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), found AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words) - len(phrase) + 1),
                                           lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place
  FROM w, (VALUES {phrases}) AS p(phrase, label)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         list_sort(list(DISTINCT label)) AS labels
  FROM found GROUP BY doc_id
), blocks AS (
  SELECT doc_id, list_distinct(words[start + 1:start + {window}]) AS block
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - {stride + 1}, 0) + 1, {stride})) AS start FROM w)
), matched AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(shared / size) AS best FROM (
    SELECT doc_id, label, len(notice)::DOUBLE AS size, len(list_intersect(block, notice)) AS shared
    FROM blocks, (VALUES {notices}) AS t(label, notice))
  WHERE shared >= {licenses.CONTAINMENT} * size - 1e-9 GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base b USING (doc_id) LEFT JOIN matched m USING (doc_id)"""


def _group(i: int) -> str:
    return f"('0x' || substr(h, {8 * i - 7}, 8))::BIGINT"


def _joined(pieces: str) -> str:
    return f"array_to_string({pieces}, '')"


# Units by a regular expression, pieces as slices of their list.
FILL_IN_MIDDLE = f"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, len(units) AS n, least({_group(1)} % (n + 1), {_group(2)} % (n + 1)) AS a,
         greatest({_group(1)} % (n + 1), {_group(2)} % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_group(3)} % 100 >= 90
              THEN 'plain' WHEN {_group(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, {_joined('units[:a]')} AS prefix, {_joined('units[a + 1:b]')} AS middle, {_joined('units[b + 1:]')} AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def centroid_clusters(clusters: int = 8, rounds: int = 10) -> str:
    """Each round as two tables; products of integers below 2^53 are exact in double precision."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, m.c, (list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, m.x) + list_dot_product(m.x, m.x))::BIGINT AS d
    FROM v, m{i} m) GROUP BY vec_id
)"""

    def moved(i: int) -> str:
        return f"""m{i + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(mean, m.x) AS x FROM m{i} m LEFT JOIN (
    SELECT c, list(s ORDER BY k) AS mean FROM (
      SELECT c, k, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS s
      FROM (SELECT a.c, unnest(v.x)::BIGINT AS e, generate_subscripts(v.x, 1) AS k FROM a{i} a JOIN v USING (vec_id))
      GROUP BY c, k) GROUP BY c) USING (c)
)"""

    steps = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {clusters}
), {steps}, {assigned(rounds)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} m USING (c)"""


# Lengths of the formatted texts by running sums; digests straight from the turns.
_ESCAPED = (
    "regexp_replace({}, '([<\\[])(\\\\*)(\\|turn\\|>|\\|says\\|>|\\|end\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>"
    "|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)', '\\1\\\\\\2\\3', 'g')"
)
CHAT_FORMAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 23)
           OVER (PARTITION BY conv_id, turn // 32 ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id, turn // 32 ORDER BY turn DESC, role DESC, text DESC) = 1 AS ends
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR ends), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


TEXTS = {
    "op12_chat_format": CHAT_FORMAT,
    "op13_centroid_clusters": centroid_clusters(),
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op1_near_dedup": NEAR_DEDUP,
    "op5_embedding_dedup": NEAR_VECTORS,
    "op8_license_scan": license_scan(),
}
