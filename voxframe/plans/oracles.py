"""The registered queries in SQL, for a check by value in DuckDB.

Arrays are taken apart into rows here, while the Spark side works on arrays,
so the two sides share no method.
"""

from __future__ import annotations

from voxframe.operators.sequences import FIRST_WORD
from voxframe.plans.queries import TOP, VOCAB

_TEXT = "CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END"

CLIPS = f"""clips AS (
  SELECT doc_id AS clip_id, doc_id AS pos, {_TEXT} AS text, lang, source, n_chars,
         CAST(n_chars AS DOUBLE) / 15.0 AS duration, doc_id % 13 <> 0 AS has_audio,
         regexp_matches({_TEXT}, '\\S') AS has_text
  FROM documents)"""

VECTORS = """vectors AS (
  SELECT vec_id, vec_id // 10 AS example_pos, CAST(vec_id % 10 AS INTEGER) AS tok_pos,
         CASE WHEN vec_id % 10 >= 8 THEN -100 ELSE label END AS label_id,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
teacher AS (
  SELECT vec_id, example_pos, tok_pos, label_id, CAST(unnest(range(len(e))) AS INTEGER) AS token_id, unnest(e) * 10 AS logit
  FROM vectors),
student AS (
  SELECT (t.vec_id - 1 + n.n) % n.n AS vec_id, token_id, logit
  FROM teacher t, (SELECT count(*) AS n FROM embeddings) n WHERE token_id < 63)"""

RANKED = f"""ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS INTEGER) AS rank FROM teacher),
top AS (SELECT * FROM ranked WHERE rank <= {TOP})"""

# both sides cut to the shared vocabulary
ALIGNED = f"""aligned AS (SELECT * FROM teacher WHERE token_id < 63),
aligned_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS INTEGER) AS rank FROM aligned),
aligned_top AS (SELECT * FROM aligned_ranked WHERE rank <= {TOP})"""

TEMPS = "temps AS (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS temperature)"

LOSSES = f"""{VECTORS}, {ALIGNED}, {TEMPS},
student_norm AS (
  SELECT vec_id, temperature, ln(sum(exp(logit / temperature))) AS z
  FROM student, temps GROUP BY vec_id, temperature),
ce_rows AS (
  SELECT v.vec_id, n.z - s.logit AS ce
  FROM vectors v JOIN student s ON s.vec_id = v.vec_id AND s.token_id = v.label_id
  JOIN student_norm n ON n.vec_id = v.vec_id AND n.temperature = 1.0
  WHERE v.label_id <> -100),
ce_all AS (SELECT avg(ce) AS ce, count(*) AS positions FROM ce_rows)"""


def _kl(source: str) -> str:
    return f"""kl_norm AS (
  SELECT vec_id, temperature, ln(sum(exp(logit / temperature))) AS z
  FROM {source}, temps GROUP BY vec_id, temperature),
kl_rows AS (
  SELECT t.vec_id, n.temperature, exp(t.logit / n.temperature - n.z) *
    ((t.logit / n.temperature - n.z) - (s.logit / n.temperature - sn.z)) AS term
  FROM {source} t
  JOIN student s ON s.vec_id = t.vec_id AND s.token_id = t.token_id
  JOIN kl_norm n ON n.vec_id = t.vec_id
  JOIN student_norm sn ON sn.vec_id = t.vec_id AND sn.temperature = n.temperature
  WHERE t.label_id <> -100),
kl_all AS (
  SELECT temperature, sum(term) / count(DISTINCT vec_id) * temperature * temperature AS kl,
         count(DISTINCT vec_id) AS positions
  FROM kl_rows GROUP BY temperature)"""


_COMBINED = """SELECT alpha, temperature, k.positions, round(ce, 6) AS ce, round(kl, 6) AS kl,
  round(alpha * ce + (1 - alpha) * kl, 6) AS loss
FROM kl_all k, ce_all c, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS alpha)"""

# Words between spaces, after runs of two or more white space characters
# became one space: a lone line break stays inside its word. The spoilt copies
# use a word that no text has. Removing d words and replacing s others by it
# takes exactly d + s edits: each new word costs one edit of its own, and the
# missing length d more. Replacing and adding f such words takes exactly f.
# The number of edits is therefore counted, not searched for.
PAIRS = f"""{CLIPS},
words AS (
  SELECT clip_id, lang, duration, text,
    len(list_filter(string_split(trim(regexp_replace(text, '\\s\\s+', ' ', 'g'), E' \\t\\n\\r\\f\\x0b'), ' '), lambda w: w <> '')) AS n
  FROM clips WHERE has_text),
pairs AS (
  SELECT clip_id, lang, duration, text, n, model,
    CASE model WHEN 1 THEN n // 6 + n // 8 - n // 24
               WHEN 2 THEN n // 7 + n // 13
               ELSE n // 9 + n // 5 - n // 45 END AS edits
  FROM words, (SELECT unnest([1, 2, 3]) AS model))"""

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g'))"
_USED = f"""WITH ours AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
used AS (
  SELECT {_NORMAL} AS t FROM (
    SELECT unnest(string_split(text, chr(10))) AS text FROM documents
    UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)
  WHERE text IS NOT NULL)"""


def _grams(text: str) -> str:
    """Share of repeated sequences of three words, taken apart into rows."""
    return rf"""split AS (
  SELECT doc_id, list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS g FROM split WHERE len(w) >= 3),
shares AS (SELECT doc_id, 1 - count(DISTINCT g)::DOUBLE / count(*) AS score FROM grams GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(score, 0) AS score FROM split LEFT JOIN shares USING (doc_id))"""


_MARKED = "CASE WHEN doc_id % 19 = 0 THEN text || ' [BLANK_AUDIO]' ELSE text END"
_OUTPUTS = f"""{_grams(_MARKED)},
outputs AS (
  SELECT doc_id AS clip_id, {_MARKED} AS text,
    regexp_matches(text, '\\S') AND doc_id % 19 <> 0 AND score <= 0.5
      AND coalesce(length({_MARKED}) / nullif(n_chars / 15.0::DOUBLE * CASE WHEN doc_id % 7 = 0 THEN 20 ELSE 1 END, 0) >= 1, true) AS fine
  FROM documents JOIN scored USING (doc_id))"""

RUNS = """runs AS (
  SELECT event_id, CAST(user_id % 6 AS INTEGER) AS run, event_type,
    list_extract([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE], CAST((user_id % 6) // 2 + 1 AS INTEGER)) AS alpha,
    CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS temperature,
    row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) AS step,
    value AS loss, epoch_us(ts) / 1e6 AS seconds,
    CASE WHEN event_type = 'purchase' AND user_id % 6 <> 5 THEN value / 100 END AS eval_wer
  FROM events),
logged AS (SELECT * FROM runs WHERE eval_wer IS NOT NULL),
run_ids AS (SELECT DISTINCT run, alpha, temperature FROM runs),
finals AS (SELECT run, eval_wer AS last FROM
  (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM logged) WHERE r = 1),
bests AS (SELECT run, step AS best_step, eval_wer AS best FROM
  (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_wer, step) AS r FROM logged) WHERE r = 1)"""

FILES = """files AS (
  SELECT event_id, CAST(user_id % 6 AS INTEGER) AS run,
    CASE WHEN event_type = 'error' THEN 'checkpoint-x'
         ELSE 'checkpoint-' || CAST(event_id // 40 * 250 AS VARCHAR) END AS dir,
    CASE event_type WHEN 'click' THEN 'config.json' WHEN 'view' THEN 'model.safetensors'
      WHEN 'purchase' THEN 'tokenizer.json' WHEN 'signup' THEN 'optimizer.pt' ELSE 'tmp' END AS file_name,
    CAST(floor(value * 1000) AS BIGINT) AS size
  FROM events),
snaps AS (
  SELECT DISTINCT run, dir, CAST(regexp_extract(dir, '^checkpoint-(\\d+)$', 1) AS BIGINT) AS step
  FROM files WHERE regexp_matches(dir, '^checkpoint-\\d+$'))"""

# one row per word of a text, i from 0
TOKENS = f"""{CLIPS},
split AS (
  SELECT clip_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM clips),
tokens AS (SELECT clip_id, unnest(range(len(w))) AS i, unnest(w) AS token FROM split),
vocab AS (
  SELECT token, n, CAST(rank + {FIRST_WORD - 1} AS INTEGER) AS token_id FROM (
    SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS rank
    FROM tokens GROUP BY token)
  WHERE rank <= {VOCAB - FIRST_WORD})"""


def _wrapped(cut: int) -> str:
    """Ids with start (2) and end (3) around the words, cut to `cut`."""
    return f"""{TOKENS},
edged AS (
  SELECT clip_id, 0 AS i, 2 AS id FROM split
  UNION ALL
  SELECT t.clip_id, t.i + 1, coalesce(v.token_id, 1) FROM tokens t LEFT JOIN vocab v USING (token)
  UNION ALL
  SELECT clip_id, len(w) + 1, 3 FROM split),
encoded AS (SELECT * FROM edged WHERE i < {cut})"""


_BATCHED = f"""{_wrapped(448)},
placed AS (SELECT clip_id, clip_id // 16 AS batch, clip_id % 16 AS in_batch FROM clips),
batched AS (
  SELECT p.clip_id, p.batch, id,
    CASE WHEN p.batch % 5 = 0 AND p.in_batch % 2 = 1 THEN i - 1 ELSE i END AS i
  FROM encoded JOIN placed p USING (clip_id)
  WHERE NOT (p.batch % 5 = 0 AND p.in_batch % 2 = 1 AND i = 0)),
width AS (SELECT batch, max(i) + 1 AS m, bool_and(id = 2) FILTER (WHERE i = 0) AS common
          FROM batched GROUP BY batch),
cells AS (SELECT clip_id, batch, m, common, unnest(range(m)) AS i FROM placed JOIN width USING (batch)),
padded AS (
  SELECT c.clip_id, c.batch, c.m, c.common, c.i, b.id
  FROM cells c LEFT JOIN batched b ON b.clip_id = c.clip_id AND b.i = c.i)"""

def _key(seed: int | str, key: str = "clip_id") -> str:
    return f"md5({seed} || '-' || CAST({key} AS VARCHAR))"


_WEIGHTS = "[" + ", ".join(str((i % 7 - 3) / 4.0) for i in range(64)) + "]"


_SAMPLES = "list_transform(string_split(text, ''), lambda c: (unicode(c) % 64 - 32) / 32.0::DOUBLE)"
_WAVES = f"waves AS (SELECT doc_id AS clip_id, {_SAMPLES} AS x FROM documents)"
# From 44.1 to 16 kHz: output o stands at sample o * 441 / 160, 178 taps of a Hann-windowed sinc around it
_RESAMPLED = f"""raw AS (
  SELECT doc_id AS clip_id, list_concat(list_resize([]::DOUBLE[], 88, 0.0::DOUBLE), x, list_resize([]::DOUBLE[], 356, 0.0::DOUBLE)) AS x,
    (len(x) * 160 + 440) // 441 AS n
  FROM (SELECT doc_id, {_SAMPLES} AS x FROM documents)),
gaps AS (SELECT p, i, p / 160.0::DOUBLE - i AS g FROM (SELECT unnest(range(160)) AS p), (SELECT unnest(range(-88, 90)) AS i)),
taps AS (
  SELECT p, list(CASE WHEN abs(g) > 89 THEN 0 ELSE 160 / 441.0::DOUBLE * (0.5 + 0.5 * cos(pi() * g / 89))
      * CASE WHEN g = 0 THEN 1 ELSE sin(pi() * g * 160 / 441.0::DOUBLE) / (pi() * g * 160 / 441.0::DOUBLE) END END ORDER BY i) AS w
  FROM gaps GROUP BY p),
blocks AS (
  SELECT clip_id, n, b, list_slice(x, b * 441 + 1, b * 441 + 619) AS x
  FROM (SELECT clip_id, n, x, unnest(range((n + 159) // 160)) AS b FROM raw)),
around AS (
  SELECT clip_id, b * 160 + j AS o, (j * 441) % 160 AS p, list_slice(x, j * 441 // 160 + 1, j * 441 // 160 + 178) AS s
  FROM (SELECT *, unnest(range(160)) AS j FROM blocks) WHERE b * 160 + j < n),
waves AS (SELECT clip_id, list(list_dot_product(s, w) ORDER BY o) AS x FROM around JOIN taps USING (p) GROUP BY clip_id)"""

# Log-mel features by a plain Fourier sum per frame.
_FEATURES = """,
mels AS (
  SELECT m, CASE WHEN mel < 15 THEN mel * 200.0 / 3.0 ELSE 1000.0 * exp((mel - 15) * ln(6.4) / 27.0) END AS hz
  FROM (SELECT m, m * (15 + 27.0 * ln(8.0) / ln(6.4)) / 81.0 AS mel FROM (SELECT unnest(range(82)) AS m))),
bands AS (
  SELECT a.m, list(greatest(0.0, least((k * 40.0 - a.hz) / (b.hz - a.hz), (c.hz - k * 40.0) / (c.hz - b.hz)))
      * 2.0 / (c.hz - a.hz) ORDER BY k) AS w
  FROM mels a JOIN mels b ON b.m = a.m + 1 JOIN mels c ON c.m = a.m + 2, (SELECT unnest(range(201)) AS k)
  GROUP BY a.m),
basis AS (
  SELECT k, list((0.5 - 0.5 * cos(2 * pi() * j / 400)) * cos(2 * pi() * ((k * j) % 400) / 400) ORDER BY j) AS re,
            list((0.5 - 0.5 * cos(2 * pi() * j / 400)) * sin(2 * pi() * ((k * j) % 400) / 400) ORDER BY j) AS im
  FROM (SELECT unnest(range(201)) AS k), (SELECT unnest(range(400)) AS j) GROUP BY k),
tracks AS (
  SELECT clip_id, len(x) AS n, least(3000, (len(x) + 359) // 160) AS used,
    list_concat(list_reverse(list_slice(list_concat(x, list_resize([]::DOUBLE[], 201, 0.0::DOUBLE)), 2, 201)),
                x, list_resize([]::DOUBLE[], 700, 0.0::DOUBLE)) AS track
  FROM waves),
frames AS (
  SELECT clip_id, t, list_slice(track, t * 160 + 1, t * 160 + 400) AS f
  FROM (SELECT clip_id, track, unnest(range(used)) AS t FROM tracks)),
spectra AS (
  SELECT clip_id, t, list(pow(list_dot_product(f, re), 2) + pow(list_dot_product(f, im), 2) ORDER BY k) AS p
  FROM frames, basis GROUP BY clip_id, t),
logs AS (
  SELECT clip_id, t, m, log10(greatest(list_dot_product(p, w), 1e-10)) AS v FROM spectra, bands),
peaks AS (SELECT clip_id, greatest(max(v), -10.0) AS peak FROM logs GROUP BY clip_id)
SELECT l.clip_id, round(any_value(n) / 16000.0::DOUBLE, 7) AS duration, CAST(any_value(used) AS INTEGER) AS n_frames,
  round(avg((greatest(v, peak - 8) + 4) / 4), 5) AS mean,
  round(max((greatest(v, peak - 8) + 4) / 4), 5) AS top,
  round(any_value((greatest(-10.0, peak - 8) + 4) / 4), 5) AS fill
FROM logs l JOIN peaks USING (clip_id) JOIN tracks USING (clip_id) GROUP BY l.clip_id"""


_FULL_SHUFFLE = f"""WITH {CLIPS}
SELECT clip_id, row_number() OVER (ORDER BY {_key(42)}, clip_id) - 1 AS shuffle_pos FROM clips"""

_RANK_RUNS = f"""WITH {RUNS},
ranked AS (
  SELECT run, alpha, temperature, last AS wer,
    row_number() OVER (ORDER BY last ASC NULLS LAST, alpha, temperature) AS rank
  FROM run_ids LEFT JOIN finals USING (run))
SELECT run, alpha, temperature, round(wer, 6) AS wer, CAST(rank AS INTEGER) AS rank,
  rank = 1 AND wer IS NOT NULL AS is_best FROM ranked"""


_SCORED = f"""WITH {VECTORS}, {RANKED}
SELECT vec_id AS example_pos, 0 AS tok_pos, rank, token_id, round(CAST(CAST(logit AS FLOAT) AS DOUBLE), 6) AS logit
FROM top WHERE vec_id % 17 <> 0"""

_ALIGNED_SCORES = f"""WITH {CLIPS}, {VECTORS}
SELECT v.example_pos, v.tok_pos, c.lang, v.label_id, round(max(t.logit), 6) AS best_logit
FROM clips c JOIN vectors v ON v.example_pos = c.pos JOIN teacher t ON t.vec_id = v.vec_id
WHERE c.has_text AND c.has_audio GROUP BY ALL"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "scan_split": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr'",
    "stream_valid_clips": f"WITH {CLIPS} SELECT clip_id, text, lang FROM clips WHERE has_text AND has_audio",
    "topk_roundtrip": f"""WITH {VECTORS}, {RANKED}
SELECT example_pos, tok_pos, rank, token_id, round(CAST(CAST(logit AS FLOAT) AS DOUBLE), 6) AS logit FROM top""",
    "optional_split": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de'",
    "stream_scores": _SCORED,
    "scores_in_parts": _SCORED,
    "stream_progress": f"""SELECT {TOP} AS top_k, max(vec_id) + 1 AS next_idx,
  count(*) FILTER (WHERE vec_id % 17 <> 0) AS examples_processed, true AS complete FROM embeddings""",
    "score_source": f"""WITH {VECTORS}, {RANKED}
SELECT example_pos, tok_pos, rank, token_id, round(CAST(CAST(logit AS FLOAT) AS DOUBLE), 6) AS logit,
  unnest(['live', 'stored']) AS source FROM top""",
    "run_log": f"""WITH {RUNS}
SELECT event_id AS step, CAST(run AS DOUBLE) AS epoch, round(loss, 6) AS loss, round(eval_wer, 6) AS eval_wer FROM runs""",
    "snapshot_listing": f"""WITH {FILES}
SELECT 'run=' || run AS run, 'file_name=' || file_name AS dir, true AS has_bytes FROM files GROUP BY run, file_name""",
    "log_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
    "artifact_size": f"WITH {FILES} SELECT run, dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY run, dir",
    # rows
    "valid_rows": f"WITH {CLIPS} SELECT clip_id, lang, text FROM clips WHERE has_text AND has_audio",
    "valid_text": f"WITH {CLIPS} SELECT clip_id, lang FROM clips WHERE has_text",
    "duration_filter": f"WITH {CLIPS} SELECT clip_id, round(duration, 6) AS duration FROM clips WHERE duration <= 29.0",
    "project_prepared": f"WITH {CLIPS} SELECT clip_id, text FROM clips",
    "cap_then_filter": f"""WITH {CLIPS}
SELECT clip_id, lang FROM (SELECT * FROM clips ORDER BY pos LIMIT 500) WHERE has_text AND has_audio""",
    "filter_then_cap": f"WITH {CLIPS} SELECT clip_id, lang FROM clips WHERE has_text ORDER BY pos LIMIT 500",
    # order
    "with_position": "SELECT doc_id AS clip_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents",
    "file_position": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents",
    "position_in_source": """SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents""",
    "seeded_shuffle": f"""WITH {CLIPS},
placed AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS pos FROM clips)
SELECT clip_id, pos, row_number() OVER (ORDER BY pos // 256, {_key(42)}, clip_id) - 1 AS shuffle_pos FROM placed""",
    "full_shuffle": _FULL_SHUFFLE,
    "stream_shuffle": _FULL_SHUFFLE,
    "stream_buffers": f"""WITH {CLIPS},
placed AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS pos FROM clips)
SELECT clip_id, row_number() OVER (ORDER BY pos // 100, {_key(42)}, clip_id) - 1 AS shuffle_pos FROM placed""",
    "repeat_epochs": f"""WITH {CLIPS}, epochs AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS epoch)
SELECT clip_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {_key('CAST(42 + epoch AS VARCHAR)')}, clip_id) - 1
  AS epoch_pos FROM clips, epochs""",
    "assign_batches": f"""WITH {CLIPS},
placed AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS pos FROM clips)
SELECT clip_id, pos, pos // 16 AS batch, CAST(pos % 16 AS INTEGER) AS in_batch FROM placed""",
    "step_plan": f"""WITH {CLIPS},
placed AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS pos FROM clips WHERE duration <= 29.0),
size AS (SELECT (count(*) + 3) // 4 AS per_epoch FROM placed),
plan AS (
  SELECT clip_id, pos, CAST(epoch AS INTEGER) AS epoch, epoch * per_epoch + pos // 4 AS micro_batch
  FROM placed, size, (SELECT unnest(range(3)) AS epoch))
SELECT *, micro_batch // 4 AS step FROM plan WHERE micro_batch // 4 < 40""",
    "steps_per_epoch": """SELECT (count(*) + 15) // 16 AS steps_per_epoch, 'batches' AS form FROM documents
UNION ALL SELECT count(*) // 4, 'rows' FROM documents""",
    "resume_window": """WITH placed AS (
  SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT * FROM placed WHERE pos >= 300 AND pos < 900""",
    # sequences
    "build_vocab": f"WITH {TOKENS} SELECT token, n, token_id FROM vocab",
    "encode_text": f"""WITH {TOKENS},
ids AS (SELECT t.clip_id, t.i, coalesce(v.token_id, 1) AS id FROM tokens t LEFT JOIN vocab v USING (token) WHERE t.i < 448),
texts AS (SELECT clip_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS labels FROM ids GROUP BY clip_id)
SELECT clip_id, coalesce(labels, '') AS labels FROM clips LEFT JOIN texts USING (clip_id)""",
    "decode_ids": f"""WITH {_wrapped(256)},
shown AS (SELECT * FROM encoded WHERE i % 10 <> 9 AND id NOT IN (2, 3)),
texts AS (
  SELECT clip_id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY i) AS decoded
  FROM shown s LEFT JOIN vocab v ON v.token_id = s.id GROUP BY clip_id)
SELECT clip_id, coalesce(decoded, '') AS decoded FROM clips LEFT JOIN texts USING (clip_id)""",
    "pad_batch": f"""WITH {_BATCHED}
SELECT clip_id, batch, string_agg(CAST(coalesce(id, -100) AS VARCHAR), ' ' ORDER BY i) AS labels
FROM padded GROUP BY clip_id, batch""",
    "drop_common_start": f"""WITH {_BATCHED}
SELECT clip_id, batch, string_agg(CAST(coalesce(id, -100) AS VARCHAR), ' ' ORDER BY i) AS labels
FROM padded WHERE i > 0 OR NOT common GROUP BY clip_id, batch""",
    "training_batches": f"""WITH {_wrapped(448)},
placed AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS pos, has_text AND has_audio AS ok FROM clips),
mixed AS (SELECT clip_id, ok, row_number() OVER (ORDER BY pos // 256, {_key(42)}, clip_id) AS m FROM placed),
numbered AS (SELECT clip_id, row_number() OVER (ORDER BY m) - 1 AS place FROM mixed WHERE ok),
lengths AS (
  SELECT n.clip_id, place // 16 AS batch, CAST(place % 16 AS INTEGER) AS in_batch, max(i) + 1 AS n
  FROM numbered n JOIN encoded e USING (clip_id) GROUP BY ALL),
width AS (SELECT batch, max(n) AS m FROM lengths GROUP BY batch),
cells AS (SELECT clip_id, batch, in_batch, unnest(range(1, m)) AS i FROM lengths JOIN width USING (batch))
SELECT c.clip_id, c.batch, c.in_batch, string_agg(CAST(coalesce(e.id, -100) AS VARCHAR), ' ' ORDER BY c.i) AS labels
FROM cells c LEFT JOIN encoded e ON e.clip_id = c.clip_id AND e.i = c.i GROUP BY ALL""",
    "shift_right": f"""WITH {_BATCHED}
SELECT clip_id, string_agg(CAST(CASE WHEN i = 0 THEN 2 ELSE coalesce(prev, 0) END AS VARCHAR), ' ' ORDER BY i) AS shifted
FROM (SELECT *, lag(id) OVER (PARTITION BY clip_id ORDER BY i) AS prev FROM padded) GROUP BY clip_id""",
    "pad_mask": f"""WITH {_BATCHED}
SELECT clip_id, string_agg(CAST(coalesce(id, -100) AS VARCHAR), ' ' ORDER BY i) AS masked,
  string_agg(CASE WHEN id IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY i) AS mask
FROM padded GROUP BY clip_id""",
    # scores and losses
    "topk_per_position": f"""WITH {VECTORS}, {RANKED}
SELECT example_pos, tok_pos, rank, token_id, round(logit, 6) AS logit FROM top""",
    "topk_wide": f"""WITH {VECTORS},
wide AS (
  SELECT vec_id, example_pos, tok_pos, CAST(i * 64 + token_id AS INTEGER) AS token_id, logit - i / 4.0::DOUBLE AS logit
  FROM teacher, (SELECT unnest(range(20)) AS i)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS INTEGER) AS rank FROM wide)
SELECT example_pos, tok_pos, rank, token_id, round(logit, 6) AS logit FROM ranked WHERE rank <= 100""",
    "topk_long": f"""WITH {VECTORS}, {RANKED}
SELECT example_pos, tok_pos, rank, token_id, round(logit, 6) AS logit FROM top""",
    "softmax_t": f"""WITH {VECTORS}
SELECT example_pos, tok_pos, token_id, round(exp(logit / 2) / sum(exp(logit / 2)) OVER (PARTITION BY vec_id), 6) AS p
FROM teacher""",
    "log_softmax_t": f"""WITH {VECTORS}
SELECT example_pos, tok_pos, token_id, round(logit / 2 - ln(sum(exp(logit / 2)) OVER (PARTITION BY vec_id)), 6) AS log_p
FROM teacher""",
    "topk_renorm": f"""WITH {VECTORS}, {RANKED}
SELECT example_pos, tok_pos, rank, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id), 6) AS p FROM top""",
    "vocab_align": f"""WITH {VECTORS}, {ALIGNED},
s AS (SELECT vec_id, count(*) AS n, sum(logit) AS total FROM student GROUP BY vec_id)
SELECT a.example_pos, a.tok_pos, CAST(count(*) AS INTEGER) AS n_teacher, CAST(any_value(s.n) AS INTEGER) AS n_student,
  round(sum(a.logit), 6) AS sum_teacher, round(any_value(s.total), 6) AS sum_student
FROM aligned a JOIN s USING (vec_id) GROUP BY a.example_pos, a.tok_pos""",
    "loss_mask": f"WITH {VECTORS} SELECT example_pos, tok_pos, label_id <> -100 AS scored FROM vectors",
    "align_scores": _ALIGNED_SCORES,
    "align_bucketed": _ALIGNED_SCORES,
    "align_packed": f"""WITH {CLIPS}, {VECTORS}, {RANKED},
best AS (
  SELECT example_pos, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY tok_pos) AS best
  FROM ranked WHERE rank = 1 GROUP BY example_pos)
SELECT b.example_pos, c.text, b.best FROM clips c JOIN best b ON b.example_pos = c.pos WHERE c.has_text AND c.has_audio""",
    "gather_topk": f"""WITH {VECTORS}, {RANKED},
norm AS (SELECT vec_id, ln(sum(exp(logit))) AS z FROM student GROUP BY vec_id)
SELECT t.example_pos, t.tok_pos, t.rank, t.token_id, round(t.logit, 6) AS logit, round(s.logit - z, 6) AS log_q
FROM top t JOIN student s ON s.vec_id = t.vec_id AND s.token_id = t.token_id JOIN norm n ON n.vec_id = t.vec_id""",
    "gather_topk_array": f"""WITH {VECTORS}, {ALIGNED},
norm AS (SELECT vec_id, ln(sum(exp(logit))) AS z FROM student GROUP BY vec_id)
SELECT t.example_pos, t.tok_pos, t.rank, t.token_id, round(s.logit - z, 6) AS log_q
FROM aligned_top t JOIN student s ON s.vec_id = t.vec_id AND s.token_id = t.token_id JOIN norm n ON n.vec_id = t.vec_id""",
    "cross_entropy": f"WITH {LOSSES} SELECT positions, round(ce, 6) AS ce FROM ce_all",
    "kl_full": f"WITH {LOSSES}, {_kl('aligned')} SELECT temperature, positions, round(kl, 6) AS kl FROM kl_all",
    "kl_topk": f"WITH {LOSSES}, {_kl('aligned_top')} SELECT temperature, positions, round(kl, 6) AS kl FROM kl_all",
    "combined_loss": f"WITH {LOSSES}, {_kl('aligned_top')} {_COMBINED}",
    "combined_loss_full": f"WITH {LOSSES}, {_kl('aligned')} {_COMBINED}",
    "stored_loss": f"""WITH {LOSSES}, {RANKED},
kept AS (SELECT * REPLACE (CAST(CAST(logit AS FLOAT) AS DOUBLE) AS logit) FROM top WHERE token_id < 63),
{_kl('kept')} {_COMBINED}""",
    "vector_mse": f"""WITH {VECTORS},
per AS (
  SELECT t.example_pos, t.vec_id, avg(pow(t.logit - s.logit, 2)) AS mse
  FROM teacher t JOIN student s ON s.vec_id = t.vec_id AND s.token_id = t.token_id GROUP BY ALL)
SELECT example_pos, round(avg(mse), 6) AS mse FROM per GROUP BY example_pos""",
    "storage_per_row": f"""WITH {VECTORS}
SELECT count(DISTINCT example_pos) AS examples, count(*) AS positions,
  round(count(*) * 404.0::DOUBLE / count(DISTINCT example_pos), 6) AS top_bytes_per_row,
  round(count(*) * 207460.0::DOUBLE / count(DISTINCT example_pos), 6) AS full_bytes_per_row
FROM vectors""",
    "pad_or_trim": f"""WITH {VECTORS},
cells AS (SELECT vec_id, example_pos, tok_pos,
  CAST(unnest(range(CASE WHEN example_pos % 2 = 0 THEN 80 ELSE 48 END)) AS INTEGER) AS i FROM vectors)
SELECT c.example_pos, c.tok_pos, c.i, round(coalesce(t.logit, 0), 6) + 0.0::DOUBLE AS v
FROM cells c LEFT JOIN teacher t ON t.vec_id = c.vec_id AND t.token_id = c.i""",
    "truncate_context": """WITH cells AS (
  SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, 2 AS bins, CAST(count(*) // 2 AS INTEGER) AS frames, round(sum(v), 6) + 0.0::DOUBLE AS total
FROM cells WHERE label = 9 OR i % 32 < 2 * (label * 3 + 1) GROUP BY vec_id""",
    # word error rate
    "word_edits": f"WITH {PAIRS} SELECT model, clip_id, edits, n AS ref_words FROM pairs",
    "split_edits": f"""WITH {PAIRS} SELECT model, clip_id, n AS ref_words,
  CASE model WHEN 1 THEN n // 8 - n // 24 WHEN 2 THEN n // 7 ELSE n // 5 - n // 45 END AS substitutions,
  CASE model WHEN 1 THEN n // 6 WHEN 2 THEN 0 ELSE n // 9 END AS deletions,
  CASE model WHEN 2 THEN n // 13 ELSE 0 END AS insertions FROM pairs""",
    "wer_corpus": f"""WITH {PAIRS}
SELECT count(*) AS samples, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS ref_words, round(sum(edits) / sum(n), 6) AS wer FROM pairs""",
    "wer_by_model": f"""WITH {PAIRS}
SELECT model, count(*) AS samples, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS ref_words, round(sum(edits) / sum(n), 6) AS wer,
  round(sum(duration * model), 6) AS elapsed_s FROM pairs GROUP BY model""",
    "wer_at_n": f"""WITH {PAIRS},
placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY clip_id) - 1 AS pos FROM pairs),
sizes AS (SELECT CAST(unnest([200, 2000, 0]) AS INTEGER) AS size)
SELECT model, size AS n, count(*) AS samples, round(sum(edits) / sum(n), 6) AS wer
FROM placed, sizes WHERE size = 0 OR pos < size GROUP BY model, size""",
    "zip_pairs": f"""WITH {CLIPS},
words AS (
  SELECT clip_id, text, CASE WHEN has_text THEN len(string_split(trim(regexp_replace(text, '\\s\\s+', ' ', 'g'), E' \\t\\n\\r\\f\\x0b'), ' ')) ELSE 0 END AS n,
    list_filter(string_split(trim(regexp_replace(text, '\\s\\s+', ' ', 'g'), E' \\t\\n\\r\\f\\x0b'), ' '), lambda w: w <> '') AS w
  FROM clips),
counted AS (
  SELECT clip_id, text, model, unnest(range(len(w))) + 1 AS i, len(string_split_regex(trim(unnest(w), E'\\n'), '\\s+')) AS k
  FROM words, (SELECT unnest([1, 2, 3]) AS model)),
sized AS (
  SELECT clip_id, model, sum(CASE
    WHEN model = 1 THEN CASE WHEN i % 6 = 0 THEN 0 WHEN i % 8 = 0 THEN 1 ELSE k END
    WHEN model = 2 THEN CASE WHEN i % 7 = 0 THEN 1 ELSE k END + CASE WHEN i % 13 = 0 THEN 1 ELSE 0 END
    ELSE CASE WHEN i % 9 = 0 THEN 0 WHEN i % 5 = 0 THEN 1 ELSE k END END) AS hyp_words
  FROM counted GROUP BY clip_id, model)
SELECT w.clip_id, m.model, CAST(length(w.text) AS INTEGER) AS ref_chars, CAST(coalesce(s.hyp_words, 0) AS INTEGER) AS hyp_words
FROM words w, (SELECT unnest([1, 2, 3]) AS model) m
LEFT JOIN sized s ON s.clip_id = w.clip_id AND s.model = m.model""",
    "vs_baseline": f"""WITH {PAIRS},
rates AS (SELECT lang AS model, model AS m, sum(edits) / sum(n) AS wer FROM pairs GROUP BY ALL)
SELECT b.model, round(b.wer, 6) AS wer_before, round(a.wer, 6) AS wer_after,
  round((b.wer - a.wer) / b.wer, 6) AS relative_reduction
FROM rates b JOIN rates a USING (model) WHERE b.m = 3 AND a.m = 2""",
    # runs and files
    "harmonise_union": """SELECT doc_id AS clip_id, text, lang, NULL::VARCHAR AS role FROM documents
UNION ALL SELECT conv_id, text, NULL, role FROM conversations""",
    "interleave": """WITH ranked AS (
  SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS n,
    (2 * row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) * CASE lang WHEN 'fr' THEN 3 ELSE 7 END AS v
  FROM documents WHERE lang IN ('fr', 'de')),
ends AS (SELECT n, max(v) AS v FROM ranked GROUP BY n),
last AS (SELECT v, n FROM ends WHERE (SELECT count(*) FROM ends) = 2 ORDER BY v, n LIMIT 1)
SELECT doc_id, lang, row_number() OVER (ORDER BY r.v, r.n) - 1 AS place
FROM ranked r, last l WHERE r.v < l.v OR r.v = l.v AND r.n <= l.n""",
    "interleave_seeded": f"""WITH ranked AS (
  SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS n,
    (2 * row_number() OVER (PARTITION BY lang ORDER BY {_key(42, "doc_id")}, doc_id) - 1) * CASE lang WHEN 'fr' THEN 3 ELSE 7 END AS v
  FROM documents WHERE lang IN ('fr', 'de')),
ends AS (SELECT n, max(v) AS v FROM ranked GROUP BY n),
last AS (SELECT v, n FROM ends WHERE (SELECT count(*) FROM ends) = 2 ORDER BY v, n LIMIT 1)
SELECT doc_id, lang, row_number() OVER (ORDER BY r.v, r.n) - 1 AS place
FROM ranked r, last l WHERE r.v < l.v OR r.v = l.v AND r.n <= l.n""",
    "merge_labelled": """WITH every AS (
  SELECT doc_id AS clip_id, text, 0 AS kind FROM documents
  UNION ALL SELECT conv_id, text, 1 FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY kind, text) AS r FROM every)
SELECT clip_id, text, kind = 0 AS supervised FROM ranked WHERE r = 1""",
    "only_new_rows": f"{_USED} SELECT doc_id FROM ours WHERE t IS NULL OR t NOT IN (SELECT t FROM used)",
    "overlap_rows": f"{_USED} SELECT doc_id FROM ours WHERE t IN (SELECT t FROM used)",
    "source_profile": f"""WITH {CLIPS}
SELECT source, count(*) AS clips, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS mean_seconds
FROM clips GROUP BY source""",
    "wer_normalised": r"""WITH words AS (
  SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
counted AS (
  SELECT lang, len(w) AS n, len(list_filter(w, lambda x: regexp_replace(x, '[\p{P}\p{S}]', '', 'g') <> '')) AS m FROM words WHERE len(w) > 0)
SELECT lang AS model, count(*) AS samples,
  round(sum(n // 7 + n // 5 - n // 35)::DOUBLE / sum(n), 6) AS wer_raw,
  round(sum(CASE WHEN m > 0 THEN n // 7 END)::DOUBLE / sum(m), 6) AS wer_normalised
FROM counted GROUP BY lang""",
    "repetition_score": f"WITH {_grams('text')} SELECT doc_id, round(score, 6) AS score FROM scored",
    "pseudo_filter": f"WITH {_OUTPUTS} SELECT clip_id FROM outputs WHERE fine",
    "pseudo_label": f"""WITH {_OUTPUTS} SELECT clip_id, length(text)::INTEGER AS chars, clip_id % 3 <> 0 AS supervised
FROM outputs WHERE clip_id % 3 <> 0 OR fine""",
    "topk_mass": f"""WITH {VECTORS}, {ALIGNED},
teacher_z AS (SELECT vec_id, ln(sum(exp(logit))) AS z FROM aligned GROUP BY vec_id),
student_z AS (SELECT vec_id, ln(sum(exp(logit))) AS z FROM student GROUP BY vec_id)
SELECT t.example_pos, t.tok_pos, round(sum(exp(t.logit - tz.z)), 6) AS kept, round(1 - sum(exp(s.logit - sz.z)), 6) AS outside
FROM aligned_top t JOIN student s ON s.vec_id = t.vec_id AND s.token_id = t.token_id
JOIN teacher_z tz ON tz.vec_id = t.vec_id JOIN student_z sz ON sz.vec_id = t.vec_id GROUP BY ALL""",
    "loss_balance": f"""WITH {LOSSES}, {_kl('aligned_top')},
board AS (SELECT alpha, temperature, ce, kl, alpha * ce + (1 - alpha) * kl AS loss
  FROM kl_all, ce_all, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS alpha))
SELECT alpha, temperature, round(kl / ce, 6) AS kl_to_ce, round((1 - alpha) * kl / loss, 6) AS kl_share FROM board""",
    "js_divergence": f"""WITH {VECTORS}, {ALIGNED},
p AS (SELECT vec_id, example_pos, tok_pos, token_id, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM aligned),
q AS (SELECT vec_id, token_id, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS q FROM student)
SELECT example_pos, tok_pos, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) AS js
FROM p JOIN q USING (vec_id, token_id) GROUP BY ALL""",
    "regression_alarm": f"""WITH {RUNS},
firsts AS (SELECT run, eval_wer AS first_wer FROM
  (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS r FROM logged) WHERE r = 1),
starts AS (SELECT run, avg(eval_wer) AS wer_start FROM runs GROUP BY run)
SELECT run, round(wer_start, 6) AS wer_start, round(first_wer, 6) AS first_wer
FROM starts JOIN firsts USING (run) WHERE first_wer > wer_start""",
    "last_metric": f"WITH {RUNS} SELECT run, round(last, 6) AS last FROM run_ids LEFT JOIN finals USING (run)",
    "best_step": f"""WITH {RUNS}
SELECT run, best_step, round(best, 6) AS best FROM run_ids LEFT JOIN bests USING (run)""",
    "quality_filter": """SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id)
WHERE NOT coalesce(quality = 0, false) AND NOT coalesce(toxic = 1, false)""",
    "skip_sources": """SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('src3', 'src7')""",
    "argmax_label": """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS label_id FROM embeddings""",
    "final_vs_best": f"""WITH {RUNS}
SELECT run, round(last, 6) AS last, round(best, 6) AS best, round(last - best, 6) AS regression
FROM run_ids LEFT JOIN finals USING (run) LEFT JOIN bests USING (run)""",
    "running_mean": f"""WITH {RUNS},
m AS (SELECT run, step, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean
      FROM runs)
SELECT run, step AS report_step, round(mean, 6) AS mean FROM m WHERE step % 20 = 0""",
    "throughput": f"""WITH {RUNS},
so_far AS (
  SELECT run, step, (step - 1) // 16 AS batch,
    count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY run ORDER BY step) AS rows_done,
    max(seconds) OVER (PARTITION BY run, (step - 1) // 16) - min(seconds) OVER (PARTITION BY run) AS elapsed
  FROM runs),
ends AS (SELECT *, row_number() OVER (PARTITION BY run, batch ORDER BY step DESC) AS r FROM so_far)
SELECT run, batch, step AS next_pos, rows_done, round(elapsed / nullif(rows_done, 0), 6) AS s_per_row,
  round(CASE WHEN elapsed = 0 THEN 0 ELSE rows_done * 60.0::DOUBLE / elapsed END, 6) AS rows_per_min
FROM ends WHERE r = 1""",
    "rank_runs": _RANK_RUNS,
    "results_table": _RANK_RUNS,
    "grid": """WITH cells AS (
  SELECT alpha, temperature, CAST(i * 2 + j AS INTEGER) AS run
  FROM (VALUES (0.5::DOUBLE, 0), (0.7::DOUBLE, 1), (0.9::DOUBLE, 2)) a(alpha, i),
       (VALUES (1.0::DOUBLE, 0), (2.0::DOUBLE, 1)) t(temperature, j)),
seen AS (
  SELECT user_id % 6 AS run, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS evals
  FROM events GROUP BY 1)
SELECT alpha, temperature, cells.run, coalesce(n, 0) AS rows, coalesce(evals, 0) AS evals
FROM cells LEFT JOIN seen ON seen.run = cells.run""",
    "is_complete": f"""WITH {FILES},
need AS (SELECT unnest(range(3)) AS i, unnest(['config.json', 'model.safetensors', 'tokenizer.json']) AS f),
dirs AS (SELECT DISTINCT run, dir FROM files),
gaps AS (
  SELECT d.run, d.dir, n.i, n.f FROM dirs d, need n
  WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.run = d.run AND x.dir = d.dir AND x.file_name = n.f)),
lists AS (SELECT run, dir, string_agg(f, ' ' ORDER BY i) AS missing FROM gaps GROUP BY run, dir)
SELECT run, dir, coalesce(missing, '') AS missing, missing IS NULL AS complete FROM dirs LEFT JOIN lists USING (run, dir)""",
    "retain_latest": f"""WITH {FILES}
SELECT run, dir, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 3 AS keep FROM snaps""",
    "latest_snapshot": f"""WITH {FILES},
runs AS (SELECT DISTINCT run FROM files),
best AS (SELECT run, dir FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM snaps) WHERE r = 1)
SELECT run, CASE WHEN run = 2 THEN (SELECT max(dir) FROM files WHERE files.run = 2 AND dir = 'checkpoint-500')
  WHEN run = 4 THEN NULL ELSE dir END AS snapshot FROM runs LEFT JOIN best USING (run)""",
    "state_or_name": f"""WITH {FILES},
named AS (SELECT event_id, file_name, coalesce(TRY_CAST(regexp_extract(dir, '^checkpoint-(\\d+)$', 1) AS BIGINT), 0) AS s FROM files)
SELECT event_id, CASE WHEN file_name = 'optimizer.pt' THEN event_id ELSE s END AS step,
  CASE WHEN file_name = 'optimizer.pt' THEN event_id // 100 ELSE s // 1000 END AS epoch FROM named""",
    "label_of_run": f"""WITH {FILES}
SELECT event_id, CASE WHEN run = 3 THEN 'out/run-3/' || dir ELSE 'run-' || run || '/' || dir END AS label FROM files""",
    # audio and user functions
    "context_size": f"""WITH {CLIPS},
base AS (
  SELECT clip_id, greatest(1, least(CAST(CAST(round_even(50.0 * duration, 0) AS DOUBLE) AS BIGINT), 1500)) AS n,
    greatest(1, least(CAST(CAST(round_even(50.0 * (duration / 10), 0) AS DOUBLE) AS BIGINT), 1500)) AS short,
    CAST('0x' || substr({_key(7)}, 1, 8) AS BIGINT) AS draw
  FROM clips),
reach AS (SELECT *, least(64, short // 3) AS j FROM base)
SELECT clip_id, CAST(n AS INTEGER) AS n_ctx,
  CAST(greatest(1, least(short + draw % (2 * j + 1) - j, 1500)) AS INTEGER) AS n_ctx_jitter FROM reach""",
    "map_rows": f"""WITH {TOKENS}
SELECT clip_id, len(w) AS n_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
FROM split JOIN clips USING (clip_id) WHERE has_text""",
    "batch_predict": f"""WITH cells AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest({_WEIGHTS}::DOUBLE[]) AS w FROM embeddings)
SELECT vec_id, round(sum(v * w), 6) + 0.0::DOUBLE AS score FROM cells GROUP BY vec_id""",
    "clip_seconds": "SELECT doc_id AS clip_id, round(length(text) / 16000.0::DOUBLE, 7) AS duration FROM documents",
    "clip_features": f"WITH {_WAVES}{_FEATURES}",
    "resampled_features": f"WITH {_RESAMPLED}{_FEATURES}",
}
