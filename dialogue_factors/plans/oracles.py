"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

from dialogue_factors.config import PERSONA_MARKER, WHITESPACE, Settings

SETTINGS = Settings()
_SEED = SETTINGS.seed
_MIN = SETTINGS.min_text_length


def _strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def _hash(*keys: str, seed: int | str = _SEED) -> str:
    return f"md5('{seed}:' || " + " || ':' || ".join(f"({k})::VARCHAR" for k in keys) + ")"


def _number(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT)"


_SPLIT = f"CASE WHEN {_number(_hash('speaker_id'))} % 100 < 80 THEN 'train' WHEN {_number(_hash('speaker_id'))} % 100 < 90 THEN 'val' ELSE 'test' END"

# Numbered lines told from conversations, parsed as far as single lines go.
_LINES = f"""
turns AS (SELECT conv_id, turn, role, regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g') AS text FROM conversations),
lines AS (
  SELECT conv_id, turn, 0 AS kind, '1 {PERSONA_MARKER} ' || text AS line FROM turns WHERE turn = 0
  UNION ALL
  SELECT u.conv_id, u.turn, 1, (u.turn + 2)::VARCHAR || ' ' || u.text || coalesce(chr(9) || a.text, '')
  FROM turns u LEFT JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
stripped AS (SELECT *, {_strip('line')} AS s FROM lines),
numbered AS (
  SELECT * EXCLUDE (s), substr(s, 1, instr(s, ' ') - 1) AS number, substr(s, instr(s, ' ') + 1) AS rest
  FROM stripped WHERE instr(s, ' ') > 0),
kinds AS (
  SELECT *, starts_with(rest, '{PERSONA_MARKER}') AS is_persona,
    number = '1' AND starts_with(rest, '{PERSONA_MARKER}') AS is_start,
    NOT starts_with(rest, '{PERSONA_MARKER}') AND contains(rest, chr(9)) AS is_dialogue,
    CASE WHEN starts_with(rest, '{PERSONA_MARKER}') THEN {_strip(f"replace(rest, '{PERSONA_MARKER}', '')")} END AS fact
  FROM numbered),
parsed AS (
  SELECT *, CASE WHEN is_dialogue THEN {_strip('split_part(rest, chr(9), 1)')} END AS said,
    CASE WHEN is_dialogue THEN {_strip('split_part(rest, chr(9), 2)')} END AS reply
  FROM kinds)"""

_EPISODES = _LINES + """,
placed AS (SELECT *, sum(is_start::INT) OVER (ORDER BY conv_id, turn, kind) AS episode FROM parsed WHERE is_persona OR is_dialogue),
gathered AS (
  SELECT episode, lower(string_agg(fact, ' ' ORDER BY conv_id, turn, kind)) AS persona_text,
    string_agg(said || chr(9) || reply, chr(9) ORDER BY conv_id, turn, kind) AS utterances, 2 * count(said) AS n_utterances
  FROM placed GROUP BY episode),
records AS (
  SELECT episode::BIGINT AS speaker_id, 0::BIGINT AS part, persona_text, utterances, n_utterances
  FROM gathered WHERE persona_text IS NOT NULL AND n_utterances > 0)"""

_UTTERANCES = f"""
utterances AS (
  SELECT conv_id AS speaker_id, turn AS pos, lower({_strip('text')}) AS text FROM conversations WHERE role <> 'system'),
labelled AS (
  SELECT speaker_id, pos, u.text, e.label FROM utterances u JOIN embeddings e ON e.vec_id = u.speaker_id
  WHERE length(u.text) > {_MIN}),
examples AS (SELECT *, {_SPLIT} AS split FROM labelled)"""

_SPEAKERS = "speakers AS (SELECT DISTINCT conv_id AS speaker_id FROM conversations)"

_SPLIT_EXACT = """split_exact AS (
  SELECT speaker_id, CASE WHEN r <= ((n + 4) // 5 + 1) // 2 THEN 'test' WHEN r <= (n + 4) // 5 THEN 'val' ELSE 'train' END AS split
  FROM ranked)"""

_RANKED = f"""{_SPEAKERS},
ranked AS (SELECT speaker_id, row_number() OVER (ORDER BY {_hash('speaker_id')}) AS r, count(*) OVER () AS n FROM speakers),
{_SPLIT_EXACT}"""

_VECTORS = "v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_LONG = f"{_VECTORS}, long AS (SELECT vec_id, label, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS value FROM v)"

_SCORED = f"""{_VECTORS},
scored AS (SELECT vec_id, label, x[1:10] AS logits, x[33:42] AS adv_logits, x[1:32] AS z_p, x[33:64] AS z_c FROM v)"""
_ARGMAX = "list_position(logits, list_max(logits)) - 1"


def _norm(v: str) -> str:
    return f"greatest(sqrt(list_inner_product({v}, {v})), 1e-12)"


_OVERLAP = f"pow(list_inner_product(z_p, z_c) / ({_norm('z_p')} * {_norm('z_c')}), 2)"


def _nll(logits: str) -> str:
    top = f"list_max({logits})"
    return f"({top} + ln(list_sum(list_transform({logits}, lambda q: exp(q - {top})))) - {logits}[label + 1])"


def _kmeans(ks: list[int], seeds: list[int], updates: int) -> str:
    """CTEs: `assigned` (k, seed, vec_id, cluster_id, d2) after the given number of updates.

    Centres start at the k first rows in the seed's hash order.
    """
    seed_rows = ", ".join(f"({s})" for s in seeds)
    k_rows = ", ".join(f"({k})" for k in ks)
    parts = [
        _LONG.replace("long AS (", "long AS MATERIALIZED ("),
        f"""drawn AS (SELECT s.seed, vec_id, x, row_number() OVER (PARTITION BY s.seed ORDER BY md5(s.seed::VARCHAR || ':' || vec_id::VARCHAR)) - 1 AS c
  FROM v, (VALUES {seed_rows}) s(seed))""",
        f"c0 AS MATERIALIZED (SELECT k, seed, c, x AS centre FROM drawn, (VALUES {k_rows}) t(k) WHERE c < k)",
    ]
    for step in range(updates + 1):
        parts.append(f"""a{step} AS MATERIALIZED (
  SELECT k, seed, vec_id, c AS cluster_id, d2 FROM (
    SELECT k, seed, vec_id, c, d2, row_number() OVER (PARTITION BY k, seed, vec_id ORDER BY d2, c) AS r FROM (
      SELECT k, seed, vec_id, c, pow(list_distance(x, centre), 2) AS d2 FROM v, c{step})) WHERE r = 1)""")
        if step < updates:
            parts.append(f"""m{step + 1} AS (
  SELECT k, seed, cluster_id, list(m ORDER BY i) AS centre FROM (
    SELECT k, seed, cluster_id, i, avg(value) AS m FROM a{step} JOIN long USING (vec_id) GROUP BY ALL) GROUP BY ALL),
c{step + 1} AS MATERIALIZED (
  SELECT o.k, o.seed, o.c, coalesce(m.centre, o.centre) AS centre
  FROM c{step} o LEFT JOIN m{step + 1} m ON m.k = o.k AND m.seed = o.seed AND m.cluster_id = o.c)""")
    parts.append(f"assigned AS (SELECT * FROM a{updates})")
    return ",\n".join(parts)


_BEST_START = """best AS (
  SELECT k, seed FROM (
    SELECT k, seed, row_number() OVER (PARTITION BY k ORDER BY cost, seed) AS r
    FROM (SELECT k, seed, sum(d2) AS cost FROM assigned GROUP BY ALL)) WHERE r = 1),
chosen AS MATERIALIZED (SELECT k, vec_id, cluster_id FROM assigned JOIN best USING (k, seed))"""


def _silhouette(distance: str, labels: str) -> str:
    """CTE `s` (k, vec_id, cluster_id, silhouette) for `labels` (k, vec_id, cluster_id)."""
    return f"""labels AS MATERIALIZED ({labels}),
pairs AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q, {distance} AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
to_cluster AS (
  SELECT l.k, p, l.cluster_id AS c, avg(d) AS d FROM pairs JOIN labels l ON l.vec_id = q GROUP BY ALL),
s AS (
  SELECT o.k, o.vec_id, o.cluster_id,
    coalesce((min(d) FILTER (c <> o.cluster_id) - max(d) FILTER (c = o.cluster_id))
      / greatest(min(d) FILTER (c <> o.cluster_id), max(d) FILTER (c = o.cluster_id)), 0.0) AS silhouette
  FROM labels o JOIN to_cluster t ON t.k = o.k AND t.p = o.vec_id GROUP BY ALL)"""


_EUCLIDEAN = "list_distance(a.x, b.x)"
_SQUARED = "pow(list_distance(a.x, b.x), 2)"
_OWN_LABELS = "SELECT 0 AS k, vec_id, label AS cluster_id FROM v"
_STARTS = list(range(_SEED, _SEED + SETTINGS.kmeans_starts))
_KS = list(range(SETTINGS.k_min, SETTINGS.k_max + 1))


def _head(name: str, source: str, out: int, width: int, shift: int) -> str:
    """Rows of one linear head over `source(vec_id, x)`, its weights given by a formula."""
    return f"""{name} AS MATERIALIZED (
  SELECT vec_id, list(value ORDER BY i) AS x FROM (
    SELECT vec_id, w.i, list_inner_product(x, w.row) + (w.i % 3 - 1) / 10.0::DOUBLE AS value
    FROM {source}, (SELECT i, list((((i * 7 + j * 3 + {shift}) % 11 - 5) / 10.0)::DOUBLE ORDER BY j) AS row
      FROM range({out}) t(i), range({width}) u(j) GROUP BY i) w) GROUP BY vec_id)"""


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_BODY = SETTINGS.max_tokens - 2

ORACLES: dict[str, str] = {
    "clean_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
s AS (SELECT doc_id, ln, {_strip('line')} AS s FROM l)
SELECT doc_id, ln::INT AS ln, substr(s, 1, instr(s, ' ') - 1) AS number, substr(s, instr(s, ' ') + 1) AS rest
FROM s WHERE instr(s, ' ') > 0""",
    "line_kinds": f"""
WITH {_LINES}
SELECT conv_id, turn, kind, number, is_start, is_persona, contains(line, '{PERSONA_MARKER}') AS mentions_persona, fact,
  CASE WHEN contains(line, '{PERSONA_MARKER}') THEN {_strip(f"split_part(line, '{PERSONA_MARKER}', 2)")} END AS fact_between,
  is_dialogue, len(string_split(rest, chr(9))) = 2 AS exactly_two, said, reply FROM parsed""",
    "episodes": f"WITH {_EPISODES} SELECT * FROM records",
    "streamed_episodes": f"""WITH {_LINES},
        placed AS (SELECT *, (conv_id % 8)::VARCHAR AS source, sum(is_start::INT) OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn, kind) AS episode
          FROM parsed WHERE is_persona OR is_dialogue)
        SELECT source, episode::BIGINT AS episode, 0::BIGINT AS part, lower(string_agg(fact, ' ' ORDER BY conv_id, turn, kind)) AS persona_text,
          string_agg(said || chr(9) || reply, chr(9) ORDER BY conv_id, turn, kind) AS utterances, 2 * count(said) AS n_utterances
        FROM placed GROUP BY source, episode HAVING count(fact) > 0 AND count(said) > 0""",
    "dialogue_files": f"WITH {_EPISODES} SELECT * FROM records",
    "source_union": f"""
WITH {_LINES},
opening AS (SELECT conv_id, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS source FROM turns WHERE turn = 0),
placed AS (
  SELECT source, p.*, sum(is_start::INT) OVER (PARTITION BY source ORDER BY conv_id, turn, kind) AS episode
  FROM parsed p JOIN opening USING (conv_id)),
gathered AS (
  SELECT source, episode, 2 * count(said) AS n_utterances FROM placed GROUP BY ALL HAVING count(fact) > 0 AND count(said) > 0)
SELECT ((source::BIGINT << 40) + episode)::BIGINT AS speaker_id, row_number() OVER (ORDER BY source, episode) - 1 AS position, source, n_utterances FROM gathered""",
    "first_fact_personas": f"""
WITH {_LINES}
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS island, 0::BIGINT AS part, lower({_strip(f"split_part(line, '{PERSONA_MARKER}', 2)")}) AS persona_text
FROM lines WHERE starts_with(line, '1 {PERSONA_MARKER}')""",
    "persona_texts": """
SELECT conv_id AS speaker_id, 0::BIGINT AS part,
  lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'system'), string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'))) AS persona_text
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role IN ('system', 'user')) > 0""",
    "flatten_utterances": f"WITH {_UTTERANCES} SELECT speaker_id, pos, text, label FROM examples",
    "flatten_records": f"""
WITH {_EPISODES},
numbered_speakers AS (SELECT *, row_number() OVER (ORDER BY speaker_id) - 1 AS position FROM records),
items AS (SELECT speaker_id, position, unnest(string_split(utterances, chr(9))) AS text, generate_subscripts(string_split(utterances, chr(9)), 1) - 1 AS pos FROM numbered_speakers)
SELECT speaker_id, pos, lower({_strip('text')}) AS text, label FROM items JOIN embeddings ON vec_id = position
WHERE length({_strip('text')}) > {_MIN}""",
    "attach_labels": f"""
WITH {_SPEAKERS},
l AS (SELECT speaker_id, row_number() OVER (ORDER BY speaker_id) - 1 AS position FROM speakers),
r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings)
SELECT position, speaker_id, vec_id, label FROM l JOIN r USING (position)""",
    "label_mismatch_report": f"""
WITH {_SPEAKERS}
SELECT count(s.speaker_id) AS n_left, count(e.vec_id) AS n_right, count(*) FILTER (s.speaker_id IS NOT NULL AND e.vec_id IS NOT NULL) AS n_matched,
  count(*) FILTER (e.vec_id IS NULL) AS n_left_only, count(*) FILTER (s.speaker_id IS NULL) AS n_right_only,
  count(s.speaker_id) <> count(e.vec_id) AS mismatch
FROM speakers s FULL JOIN embeddings e ON e.vec_id = s.speaker_id""",
    "speaker_split_exact": f"WITH {_RANKED} SELECT * FROM split_exact",
    "speaker_split_hash": f"WITH {_SPEAKERS} SELECT speaker_id, {_SPLIT} AS split FROM speakers",
    "split_overlap": f"""
WITH {_RANKED}, {_UTTERANCES},
k AS (SELECT DISTINCT speaker_id, split FROM utterances JOIN split_exact USING (speaker_id)),
p(pair, a, b) AS (VALUES ('train-val', 'train', 'val'), ('train-test', 'train', 'test'), ('val-test', 'val', 'test'))
SELECT pair, (SELECT count(*) FROM k x JOIN k y USING (speaker_id) WHERE x.split = a AND y.split = b) AS n FROM p""",
    "split_overlap_rows": f"""
WITH r AS (SELECT conv_id AS speaker_id, {_number(_hash('conv_id', 'turn'))} % 100 AS draw FROM conversations WHERE role <> 'system'),
k AS (SELECT DISTINCT speaker_id, CASE WHEN draw < 80 THEN 'train' WHEN draw < 90 THEN 'val' ELSE 'test' END AS split FROM r),
p(pair, a, b) AS (VALUES ('train-val', 'train', 'val'), ('train-test', 'train', 'test'), ('val-test', 'val', 'test'))
SELECT pair, (SELECT count(*) FROM k x JOIN k y USING (speaker_id) WHERE x.split = a AND y.split = b) AS n FROM p""",
    "class_distribution": f"WITH {_UTTERANCES} SELECT split, label, count(*) AS n FROM examples GROUP BY ALL",
    "cluster_sizes": f"WITH {_SPEAKERS} SELECT label AS cluster_id, count(*) AS n FROM speakers JOIN embeddings ON vec_id = speaker_id GROUP BY ALL",
    "split_sizes": f"WITH {_UTTERANCES} SELECT split, count(*) AS n FROM examples GROUP BY ALL",
    "json_roundtrip": f"WITH {_UTTERANCES} SELECT speaker_id, pos, text, label, split FROM examples",
    "seeded_shuffle": f"""
WITH {_UTTERANCES}
SELECT speaker_id, pos, row_number() OVER (ORDER BY {_hash('speaker_id', 'pos', seed=f'{_SEED}:0')}) AS rank FROM examples""",
    "accuracy": f"WITH {_SCORED} SELECT count(*) AS n, round(avg(({_ARGMAX} = label)::INT), 6) AS accuracy FROM scored",
    "confusion_matrix": f"""
WITH {_SCORED}, p AS (SELECT label, ({_ARGMAX})::INT AS prediction FROM scored),
classes AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
SELECT a.c AS label, b.c AS prediction, count(p.label) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY ALL""",
    "loss_terms": f"""
WITH {_SCORED}, t AS (SELECT avg({_nll('logits')}) AS c, avg({_nll('adv_logits')}) AS a, avg({_OVERLAP}) AS o FROM scored)
SELECT round(c, 6) AS classification, round(a, 6) AS adversary, round(o, 6) AS overlap,
  round(c + {SETTINGS.adversary_weight} * a + {SETTINGS.overlap_weight} * o, 6) AS total FROM t""",
    "epoch_history": f"""
WITH {_SCORED},
e AS (
  SELECT epoch::INT AS epoch, label, z_p, z_c, list_transform(logits, lambda q: q * (1 + epoch / {SETTINGS.epochs}.0::DOUBLE)) AS logits,
    list_transform(adv_logits, lambda q: q * (1 + epoch / {SETTINGS.epochs}.0::DOUBLE)) AS adv_logits
  FROM scored, range({SETTINGS.epochs}) t(epoch)),
h AS (
  SELECT epoch, avg(CASE WHEN epoch < {SETTINGS.staged_from_epoch} THEN {_nll('logits')}
      ELSE {_nll('logits')} + {SETTINGS.adversary_weight} * (epoch / {SETTINGS.epochs}.0::DOUBLE) * {_nll('adv_logits')} + {SETTINGS.overlap_weight} * {_OVERLAP} END) AS loss,
    avg(({_ARGMAX} = label)::INT) AS accuracy
  FROM e GROUP BY epoch)
SELECT epoch, 'loss' AS metric, round(loss, 6) AS value FROM h
UNION ALL SELECT epoch, 'accuracy', round(accuracy, 6) FROM h""",
    "linear_heads": f"""
WITH {_VECTORS}, {_head('z_p', 'v', 16, 64, 0)}, {_head('z_c', 'v', 16, 64, 4)},
{_head('logits', 'z_p', 10, 16, 0)}, {_head('adv_logits', 'z_c', 10, 16, 4)},
heads AS (SELECT 'z_p' AS head, * FROM z_p UNION ALL SELECT 'z_c', * FROM z_c UNION ALL SELECT 'logits', * FROM logits UNION ALL SELECT 'adv_logits', * FROM adv_logits),
cells AS (SELECT vec_id, head, (generate_subscripts(x, 1) - 1)::INT AS i, unnest(x) AS value FROM heads)
SELECT vec_id, head, i, round(value, 6) AS value FROM cells""",
    "covariance": f"""
WITH {_LONG}
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.value, b.value), 6) AS covariance
FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""",
    "pca_rotation": f"""
WITH {_LONG}, m AS (SELECT i, avg(value) AS mean FROM long GROUP BY i)
SELECT vec_id, round(sum(pow(value - mean, 2)), 6) AS squared_length FROM long JOIN m USING (i) GROUP BY vec_id""",
    "labelled_split_sizes": f"""
WITH {_EPISODES},
ranked AS (SELECT speaker_id, row_number() OVER (ORDER BY {_hash('speaker_id')}) AS r, count(*) OVER () AS n FROM records),
{_SPLIT_EXACT},
items AS (SELECT speaker_id, unnest(string_split(utterances, chr(9))) AS text FROM records)
SELECT split, count(*) AS n FROM items JOIN split_exact USING (speaker_id) WHERE length({_strip('text')}) > {_MIN} GROUP BY split""",
    "chart_sample": "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 300",
    "nearest_centroid": f"""
WITH {_LONG},
centres AS (SELECT label AS c, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(value) AS m FROM long GROUP BY ALL) GROUP BY label)
SELECT vec_id, c AS cluster_id FROM (
  SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(x, centre), c) AS r FROM v, centres) WHERE r = 1""",
    "persona_only": f"""
WITH {_LINES},
opening AS (SELECT DISTINCT conv_id FROM turns WHERE turn = 0 AND role = 'system'),
kept AS (SELECT * FROM parsed WHERE kind = 0 OR conv_id IN (SELECT conv_id FROM opening)),
placed AS (SELECT *, sum(is_start::INT) OVER (ORDER BY conv_id, turn, kind) AS episode FROM kept WHERE is_persona OR is_dialogue)
SELECT episode::BIGINT AS speaker_id, 0::BIGINT AS part, lower(string_agg(fact, ' ' ORDER BY conv_id, turn, kind)) AS persona_text, 2 * count(said) AS n_utterances
FROM placed GROUP BY episode HAVING count(fact) > 0""",
    "cluster_file_labels": f"""
WITH {_EPISODES},
numbered_speakers AS (SELECT *, row_number() OVER (ORDER BY speaker_id) - 1 AS position FROM records),
clusters AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, label FROM embeddings),
matched AS (SELECT * FROM numbered_speakers JOIN clusters USING (position)),
ranked AS (SELECT speaker_id, row_number() OVER (ORDER BY {_hash('speaker_id')}) AS r, count(*) OVER () AS n FROM matched),
{_SPLIT_EXACT},
items AS (SELECT speaker_id, label, unnest(string_split(utterances, chr(9))) AS text, generate_subscripts(string_split(utterances, chr(9)), 1) + 1 AS pos FROM matched)
SELECT speaker_id, pos, lower({_strip('text')}) AS text, label, split FROM items JOIN split_exact USING (speaker_id)
WHERE length({_strip('text')}) > {_MIN}""",
    "epoch_batches": f"""
WITH {_SCORED},
e AS (
  SELECT epoch::INT AS epoch, (row_number() OVER (PARTITION BY epoch ORDER BY {_hash('epoch', 'vec_id')}, vec_id) - 1) // {SETTINGS.batch_size} AS batch,
    ({_ARGMAX} = label)::INT AS hit, CASE WHEN epoch < {SETTINGS.staged_from_epoch} THEN {_nll('logits')}
      ELSE {_nll('logits')} + {SETTINGS.adversary_weight} * (epoch / {SETTINGS.epochs}.0::DOUBLE) * {_nll('adv_logits')} + {SETTINGS.overlap_weight} * {_OVERLAP} END AS loss
  FROM scored, range({SETTINGS.epochs}) t(epoch)),
b AS (SELECT epoch, batch, avg(loss) AS loss, sum(hit) AS hits, count(*) AS n FROM e GROUP BY epoch, batch)
SELECT epoch, count(*) AS n_batches, round(avg(loss), 6) AS loss, round(sum(hits) / sum(n)::DOUBLE, 6) AS accuracy FROM b GROUP BY epoch""",
    "model_roundtrip": f"""
WITH {_LONG},
centres AS (SELECT label AS c, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(value) AS m FROM long GROUP BY ALL) GROUP BY label),
placed AS (SELECT centre, (row_number() OVER (ORDER BY c) - 1)::INT AS up, (row_number() OVER (ORDER BY c DESC) - 1)::INT AS down FROM centres),
d AS (SELECT vec_id, up, down, list_distance(x, centre) AS distance FROM v, placed)
SELECT vec_id, arg_min(up, distance) AS cluster_id, arg_min(down, distance) AS older_id FROM d GROUP BY vec_id""",
    "kmeans_fixed_init": f"WITH {_kmeans([5], [_SEED], 3)} SELECT vec_id, cluster_id::INT AS cluster_id FROM assigned",
    "kmeans_best_of_n": f"""
WITH {_kmeans([SETTINGS.classes], _STARTS, 10)}, {_BEST_START}
SELECT vec_id, cluster_id::INT AS cluster_id FROM chosen""",
    "k_sweep": f"""
WITH {_kmeans(_KS, _STARTS, 10)}, {_BEST_START},
{_silhouette(_SQUARED, 'SELECT k, vec_id, cluster_id FROM chosen')}
SELECT k::INT AS k, round(avg(silhouette), 6) AS silhouette FROM s GROUP BY k""",
    "best_k": f"""
WITH {_kmeans(_KS, [_SEED], 3)},
{_silhouette(_EUCLIDEAN, 'SELECT k, vec_id, cluster_id FROM assigned')}
SELECT k::INT AS k, round(avg(silhouette), 6) AS silhouette FROM s GROUP BY k ORDER BY avg(silhouette) DESC, k LIMIT 1""",
    "silhouette_exact": f"WITH {_VECTORS}, {_silhouette(_EUCLIDEAN, _OWN_LABELS)} SELECT vec_id, round(silhouette, 6) AS silhouette FROM s",
    "silhouette_squared": f"""
WITH {_VECTORS}, {_silhouette(_SQUARED, _OWN_LABELS)}
SELECT cluster_id AS label, count(*) AS n, round(avg(silhouette), 6) AS silhouette FROM s GROUP BY ALL""",
    "factor_split": f"""
WITH {_LONG}, m AS (SELECT i, avg(value) AS mean FROM long GROUP BY i)
SELECT label, i::INT AS i, round(mean, 6) AS mean FROM (SELECT DISTINCT label FROM v), m""",
    "factor_lengths": f"""
WITH {_LONG}, m AS (SELECT i, avg(value) AS mean FROM long GROUP BY i),
own AS (SELECT label, i, avg(value) AS own FROM long GROUP BY label, i),
n AS (SELECT (count(DISTINCT label) - 1)::INT AS n_factors FROM v)
SELECT vec_id, n_factors, round(sum(pow(value - mean, 2)), 6) + 0.0 AS squared_length, round(sum((value - mean) * (own - mean)), 6) + 0.0 AS along_own
FROM long JOIN m USING (i) JOIN own USING (label, i), n GROUP BY vec_id, n_factors""",
    "leakage_nearest_mean": f"""
WITH {_LONG}, held AS (SELECT vec_id, label, x, {_number(_hash('vec_id'))} % 5 = 0 AS held FROM v),
centres AS (
  SELECT label AS c, list(m ORDER BY i) AS centre FROM (
    SELECT long.label, i, avg(value) AS m FROM long JOIN held USING (vec_id) WHERE NOT held GROUP BY ALL) GROUP BY label),
p AS (
  SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(x, centre), c) AS r
  FROM held, centres WHERE held)
SELECT count(*) AS n, round(avg((label = c)::INT), 6) AS accuracy FROM p WHERE r = 1""",
    "hashed_tfidf": f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
c AS (SELECT doc_id, {_number('md5(token)')} % 128 AS bucket, count(*) AS n FROM t GROUP BY ALL),
df AS (SELECT bucket, count(*) AS holding FROM c GROUP BY bucket),
w AS (SELECT doc_id, bucket, n * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (holding + 1.0::DOUBLE)) AS weight FROM c JOIN df USING (bucket)),
u AS (SELECT doc_id, bucket, weight, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS length FROM w)
SELECT doc_id, bucket::INT AS bucket, round(weight / length, 6) AS weight FROM u WHERE weight <> 0""",
    "word_pmi": f"""
WITH t AS (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)),
vocabulary AS (SELECT token FROM (SELECT token, count(*) AS n FROM t GROUP BY token) ORDER BY n DESC, token LIMIT 1000),
k AS (SELECT t.* FROM t JOIN vocabulary USING (token)),
near AS (
  SELECT a.token AS word, b.token AS context FROM k a JOIN (SELECT *, unnest(range(1, {SETTINGS.word_window} + 1)) AS step FROM k) b
  ON a.doc_id = b.doc_id AND a.pos = b.pos - b.step),
both_ways AS (SELECT word, context FROM near UNION ALL SELECT context, word FROM near),
pairs AS (SELECT word, context, count(*) AS n FROM both_ways GROUP BY ALL),
margins AS (SELECT word, sum(n)::DOUBLE AS margin FROM pairs GROUP BY word)
SELECT p.word, p.context, n, round(ln(n * (SELECT sum(margin) FROM margins) / (a.margin * b.margin)), 6) + 0.0 AS pmi
FROM pairs p JOIN margins a ON a.word = p.word JOIN margins b ON b.word = p.context
WHERE ln(n * (SELECT sum(margin) FROM margins) / (a.margin * b.margin)) > 0""",
    "encode_tokens": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
t AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM d),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM t GROUP BY token)
  ORDER BY id LIMIT {SETTINGS.vocabulary_size}),
body AS (
  SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM t LEFT JOIN vocabulary USING (token) WHERE pos <= {_BODY} GROUP BY doc_id),
full_ids AS (SELECT doc_id, list_concat(list_concat([2], coalesce(ids, [])), [3]) AS ids FROM documents LEFT JOIN body USING (doc_id))
SELECT doc_id, array_to_string(list_resize(ids, {SETTINGS.max_tokens}, 0), ' ') AS input_ids,
  array_to_string(list_transform(list_resize(ids, {SETTINGS.max_tokens}, 0), lambda i: (i <> 0)::INT), ' ') AS attention_mask
FROM full_ids""",
}
