"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT_DEDUP = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
         g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id,
                      count(*) OVER (PARTITION BY content) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g"""

#: Every window of 100 bytes, grouped by its bytes; starts that are not a group's first remove bytes.
SUFFIX_DEDUP = r"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
         w AS (SELECT doc_id, body, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100),
         later AS (SELECT doc_id, i FROM (SELECT doc_id, i, body[i:i + 99] AS piece FROM w)
                   QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, i) > 1),
         marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::int AS fresh FROM later),
         numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
         spans AS (SELECT doc_id, k, min(i) AS lo, max(i) + 99 AS hi FROM numbered GROUP BY ALL),
         edges AS (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, n + 1, n FROM d),
         gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS done FROM edges),
         kept AS (SELECT doc_id, sum(hi - lo + 1)::bigint AS n_removed, count(*) - 1 AS n_spans,
                         sha256(unhex(string_agg(hex(body[done + 1:lo - 1]), '' ORDER BY lo))) AS kept_sha256
                  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, n_removed, n_spans, kept_sha256 FROM d JOIN kept USING (doc_id)"""

DECONTAMINATE = rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
         b AS (SELECT item_id::varchar AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
         cut AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
         windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS piece FROM cut),
         places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
         found AS (SELECT doc_id, i, p.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS piece FROM places) p
                   JOIN windows USING (n, piece)),
         hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
         items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_BYTE = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _places(source: str, pattern: str, kind: int) -> str:
    """Matches with their code points: what splits before a match is as long as its start."""
    return rf"""SELECT doc_id, {kind} AS kind, v AS value,
                   (sum(length(v) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) - length(v))::bigint AS start,
                   sum(length(v) + length(g)) OVER (PARTITION BY doc_id ORDER BY i)::bigint AS stop
            FROM (SELECT doc_id, i, vs[i] AS v, gs[i] AS g
                  FROM (SELECT doc_id, vs, gs, unnest(range(1, len(vs) + 1)) AS i
                        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS vs, string_split_regex(text, '{pattern}') AS gs FROM {source})))"""


PII = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
         m AS ({_places("d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0)}
               UNION ALL {_places("d", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 1)}
               UNION ALL {_places("d", r"[0-9]([\x20-]?[0-9])+", 2)}
               UNION ALL {_places("d", r"\+[0-9][\x20().0-9-]+[0-9]", 3)}),
         n AS (SELECT *, reverse(regexp_replace(value, '[^0-9]', '', 'g')) AS digits FROM m),
         base AS (SELECT doc_id, kind, value, start, stop FROM n
                  WHERE CASE kind WHEN 0 THEN true
                                  WHEN 1 THEN regexp_full_match(value, '({_BYTE}\.){{3}}{_BYTE}')
                                  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND
                                       list_sum([CASE WHEN i % 2 = 0 THEN digits[i + 1]::int WHEN digits[i + 1]::int > 4 THEN digits[i + 1]::int * 2 - 9
                                                      ELSE digits[i + 1]::int * 2 END FOR i IN range(length(digits))]) % 10 = 0
                                  ELSE length(digits) BETWEEN 10 AND 15 END),
         near AS (SELECT row, kind, value, substring(text, greatest(start + 1 - 60, 1), least(start, 60)) AS b, substring(text, stop + 1, 60) AS a
                  FROM base JOIN d USING (doc_id)),
         beside AS (SELECT row, kind, value, b, a, unnest(list_distinct(regexp_extract_all(
                           regexp_replace(b, '^\p{{L}}+', '') || ' ' || regexp_replace(a, '\p{{L}}+$', ''), '\p{{L}}{{3,}}'))) AS term FROM near),
         entities AS (SELECT kind, value, count(DISTINCT row) AS n_entity FROM near GROUP BY ALL),
         joints AS (SELECT kind, value, term, count(DISTINCT row) AS joint, count(DISTINCT (b, a)) AS contexts FROM beside GROUP BY ALL),
         likely AS (SELECT term, joint, n_entity FROM joints JOIN entities USING (kind, value) WHERE contexts >= 3),
         counts AS (SELECT term, count(*) AS n_term
                    FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\p{{L}}{{3,}}'))) AS term FROM d) SEMI JOIN likely USING (term) GROUP BY term),
         terms AS (SELECT DISTINCT term FROM likely JOIN counts USING (term)
                   WHERE joint >= 0.5 * n_term AND log2(joint * (SELECT count(*) FROM d)::double / (n_term * n_entity)) >= 5),
         words AS ({_places("d", r"\p{L}{3,}", 4)}),
         extra AS (SELECT * FROM words SEMI JOIN terms ON value = term
                   ANTI JOIN base ON words.doc_id = base.doc_id AND words.start < base.stop AND base.start < words.stop),
         spans AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, kind, start, stop FROM extra),
         listed AS (SELECT doc_id, kind, start, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS span FROM spans),
         told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
                         count(*) FILTER (kind = 3) AS n_phone, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 4) AS base_list,
                         string_agg(span, ',' ORDER BY start, kind) AS span_list FROM listed GROUP BY doc_id)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
           sha256(coalesce(base_list, '')) AS base_sha256, coalesce(span_list, '') AS spans
    FROM d LEFT JOIN told USING (doc_id)"""


def _lloyd(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """All vectors against all centroids in every round, each round a few tables of its own."""
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS v FROM embeddings
                       WHERE len(embedding) = {size} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {size}),
         parts AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range({size})) AS i FROM kept),
         c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept
                ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), kept.v LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT row, best.c AS c, best.d AS d FROM (SELECT row, min({{'d': d, 'c': c}}) AS best FROM
                   (SELECT row, c, list_sum([(kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]) FOR i IN range(1, {size + 1})])::BIGINT AS d FROM kept, c{r}) GROUP BY row))"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM
                   (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN parts USING (row) GROUP BY c, i) GROUP BY c),
         c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
            )
    return (
        ",\n         ".join(steps)
        + f"""
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} USING (c)"""
    )


CLUSTERS = _lloyd()

#: CRC-32 by its table of 256 remainders, over the hexadecimal digits of each distinct n-gram.
RESAMPLING = rf"""
    WITH remainders AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(b))),
         d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
         b AS MATERIALIZED (SELECT {_WORDS} AS w FROM benchmark),
         words AS (SELECT row, unnest(w) AS w1, unnest(range(len(w))) AS i FROM d),
         runs AS (SELECT row, w1, lead(w1) OVER (PARTITION BY row ORDER BY i) AS w2 FROM words),
         grams AS MATERIALIZED (SELECT row, gram FROM (SELECT row, unnest([w1, w1 || ' ' || w2]) AS gram FROM runs) WHERE gram IS NOT NULL),
         aims AS MATERIALIZED (SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM b),
         coded AS MATERIALIZED (SELECT gram, xor(4294967295, list_reduce([4294967295] || [('0x' || substring(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)],
                          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
                   FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT gram FROM grams UNION SELECT gram FROM aims)), remainders),
         source AS (SELECT bucket, count(*) AS s FROM grams JOIN coded USING (gram) GROUP BY bucket),
         target AS (SELECT bucket, count(*) AS t FROM aims JOIN coded USING (gram) GROUP BY bucket),
         sums AS (SELECT (SELECT count(*) FROM grams) AS s_all, (SELECT count(*) FROM aims) AS t_all),
         gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
                   FROM source LEFT JOIN target USING (bucket), sums),
         weighed AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS g FROM grams JOIN coded USING (gram) JOIN gains USING (bucket) GROUP BY row),
         scored AS (SELECT doc_id, d.row AS row, len(w) AS words, coalesce(n, 0) AS n_features,
                           coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
                           ('0x' || substring(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weighed USING (row)),
         noisy AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM scored),
         placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER () AS n FROM noisy WHERE words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM noisy LEFT JOIN placed USING (row)"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_decontaminate": DECONTAMINATE,
    "op8_pii": PII,
    "op12_clustering": CLUSTERS,
    "op13_resampling": RESAMPLING,
}
