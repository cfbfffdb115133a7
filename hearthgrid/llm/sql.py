"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from hearthgrid.llm.sharding import SHARDS, TABLE_SIZE

WORD = r"[^\x20\x09-\x0D]+"


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


OP1 = f"""
WITH RECURSIVE shards AS (
  SELECT list(('0x' || substr(md5(s || '#start'), 1, 15))::BIGINT % {TABLE_SIZE} ORDER BY i) AS start,
         list(('0x' || substr(md5(s || '#step'), 1, 15))::BIGINT % ({TABLE_SIZE} - 1) + 1 ORDER BY i) AS step,
         list(s ORDER BY i) AS names
  FROM (SELECT unnest({list(SHARDS)}) AS s, generate_subscripts({list(SHARDS)}, 1) AS i)
),
fill(turn, owner) AS (
  SELECT 0, list_transform(range({TABLE_SIZE}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda o, i: CASE WHEN i - 1 = claimed THEN turn % {len(SHARDS)} ELSE o END)
  FROM (
    SELECT turn, owner, list_filter(
      list_transform(range({TABLE_SIZE}),
        lambda j: (start[turn % {len(SHARDS)} + 1] + j * step[turn % {len(SHARDS)} + 1]) % {TABLE_SIZE}),
      lambda s: owner[s + 1] = -1)[1] AS claimed
    FROM fill, shards WHERE turn < {TABLE_SIZE}
  )
),
filled AS (
  SELECT unnest(owner) AS number, generate_subscripts(owner, 1) - 1 AS slot
  FROM fill WHERE turn = {TABLE_SIZE}
)
SELECT d.doc_id, CAST(f.slot AS INTEGER) AS slot, shards.names[f.number + 1] AS shard
FROM documents d
JOIN filled f ON {_hash("coalesce(CAST(d.doc_id AS VARCHAR), 'null')")} % {TABLE_SIZE} = f.slot, shards
"""

OP4 = """
WITH codes AS (
  SELECT DISTINCT vec_id,
         list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
),
pairs AS (
  SELECT q.vec_id, o.vec_id AS neighbour_id,
         list_sum(list_transform(range(1, 65), lambda i: abs(q.code[i] - o.code[i])))::BIGINT AS distance
  FROM codes q JOIN codes o ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs
)
SELECT vec_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""

OP6 = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         {_hash("coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS hash
  FROM documents
),
sources AS (
  SELECT *, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)
),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM sources
),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / weight < level THEN cap::DOUBLE ELSE level * weight END AS target
  FROM (SELECT *, max(own_level) FILTER (cap / weight >= own_level) OVER () AS level FROM levels)
),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM targets
),
running AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
),
best AS (
  -- The number of words at the threshold: of all running sums, and none, the nearest.
  SELECT source, min_by(upto, (abs(upto - rest), upto)) AS words
  FROM (SELECT source, upto, rest FROM running UNION ALL SELECT DISTINCT source, 0, rest FROM running)
  GROUP BY source
)
SELECT r.doc_id, r.source, r.size, r.source_size, r.target,
       (r.size * least(2, r.whole + CASE WHEN r.upto <= b.words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_of(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_LOWER}, '{WORD}') AS words FROM {table} WHERE text IS NOT NULL"


_RUNS = "unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS shingle"

# An item of fewer than five words is one run of its own length.
OP7 = f"""
WITH items AS (SELECT *, least(len(words), 5) AS n FROM ({_words_of("benchmark", "item_id")}) WHERE len(words) > 0),
item_shingles AS (SELECT DISTINCT item_id, {_RUNS} FROM items),
doc_shingles AS (SELECT DISTINCT doc_id, {_RUNS} FROM ({_words_of("documents", "doc_id")}), (SELECT DISTINCT n FROM items)),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= greatest(1, ceil(n_item * 0.8::DOUBLE - 1e-9))
"""

# crc32 of a decimal number, by its table; 3988292384 is the fixed reversed polynomial.
_CRC_TABLE = """
  SELECT list(entry ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i] || range(8),
             lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS entry
    FROM (SELECT unnest(range(256)) AS i))"""
_CRC = """xor(list_reduce(
    [4294967295::BIGINT] || list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""
_TURN_DIGEST = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"

OP11 = f"""
WITH crc AS ({_CRC_TABLE}),
own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, {_TURN_DIGEST}) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT own.*, {_CRC} % 9 AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
),
prefixes AS (
  SELECT conv_id, depth, turns[1:depth] AS beginning, len(turns) = depth AS ended
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
),
nodes AS (
  SELECT beginning, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
         CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(beginning[-1].text) ELSE 0 END AS saved
  FROM prefixes GROUP BY beginning, depth
),
children AS (
  SELECT beginning[1:depth - 1] AS beginning, depth - 1 AS depth, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL
),
counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN children c USING (beginning, depth)
),
upward AS (
  SELECT beginning[1:up] AS beginning, up AS depth, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN upward u USING (beginning, depth)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.beginning = n.beginning[1:n.depth - 1]
"""


def _rounds(rounds: int) -> str:
    """Each round: distances, nearest centroids, floors of the means."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
near{i} AS MATERIALIZED (
  SELECT row, min_by(number, (distance, number)) AS number, min(distance) AS distance
  FROM (SELECT v.row, c.number, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
        FROM parts v JOIN centroids{i} c ON v.d = c.d GROUP BY v.row, c.number)
  GROUP BY row
)""")
        if i < rounds:
            parts.append(f"""
centroids{i + 1} AS MATERIALIZED (
  SELECT c.number, c.d, CASE WHEN n IS NULL THEN c.x ELSE ((total - ((total % n) + n) % n) // n) END AS x
  FROM centroids{i} c LEFT JOIN (
    SELECT number, d, sum(x)::BIGINT AS total, count(*) AS n
    FROM parts JOIN near{i} USING (row) GROUP BY number, d) m ON m.number = c.number AND m.d = c.d
)""")
    return ",".join(parts)


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT row, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM kept),
centroids0 AS MATERIALIZED (
  SELECT number, unnest(vector) AS x, generate_subscripts(vector, 1) AS d
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, 'null')), vector) - 1 AS number, vector FROM kept)
  WHERE number < 8
),{_rounds(10)},
final AS (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM centroids10 GROUP BY number),
sums AS (SELECT number, sum(distance)::BIGINT AS cluster_inertia FROM near10 GROUP BY number)
SELECT k.vec_id, n.number::INTEGER AS cluster, n.distance, s.cluster_inertia,
       (SELECT sum(distance)::BIGINT FROM near10) AS inertia, f.centroid_sha256
FROM near10 n JOIN kept k USING (row) JOIN sums s USING (number) JOIN final f USING (number)
"""

ORACLES = {
    "op1_sharding": OP1,
    "op4_hamming_search": OP4,
    "op6_mixing": OP6,
    "op7_decontamination": OP7,
    "op11_prefix_trie": OP11,
    "op12_centroids": OP12,
}
