"""ANSI SQL (DuckDB) for the registered queries that SQL can express."""

from __future__ import annotations

#: Common table expressions: what every query starts from.
WORDS = r"""words AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"""
LINES = r"""lines AS (SELECT regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '') AS value FROM (SELECT unnest(string_split(text, chr(10))) AS v FROM documents))"""
SENTENCES = LINES + r""", sentences AS (SELECT value AS sentence, count(*)::BIGINT AS n FROM lines WHERE value <> '' AND value NOT LIKE '#%' GROUP BY value)"""
_MARK = r"""array_to_string(list_transform(list_filter(regexp_split_to_array(sentence, '[ \t]+'), lambda x: x <> ''), lambda x: '▁' || x), '')"""
MARKED = SENTENCES + f""", marked AS (SELECT s, sum(n)::BIGINT AS n FROM (SELECT {_MARK} AS s, n FROM sentences) WHERE s <> '' GROUP BY s)"""
_CHARS = "string_split({0}, '')"
_PIECES = "list_transform(string_split(word, ''), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END)"
_PAIRS = "SELECT t[i] AS l, t[i + 1] AS r, sum(n)::BIGINT AS c FROM (SELECT {0} AS t, n FROM {1}), LATERAL (SELECT unnest(range(1, len(t))) AS i) GROUP BY 1, 2"
_TOKENS = "SELECT token, sum(n)::BIGINT AS c FROM (SELECT unnest({0}) AS token, n FROM {1}) GROUP BY token"
CHARS = MARKED + ", chars AS (SELECT ch, sum(n)::BIGINT AS c FROM (SELECT unnest(string_split(s, '')) AS ch, n FROM marked) GROUP BY ch)"
_CUT = ", cut AS (SELECT ch, c FROM (SELECT ch, c, coalesce(sum(c) OVER (ORDER BY c DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS total FROM chars) WHERE before < floor(total * {0}::DOUBLE))"


def _wrapped(tokens: str) -> str:
    return f"array_to_string(list_transform({tokens}, lambda t: chr(1) || t || chr(2)), '')"


def _opened(s: str) -> str:
    return f"string_split(substr({s}, 2, length({s}) - 2), chr(2) || chr(1))"


def _loop(start: str, limit: str, least: int = 2) -> str:
    """A recursive table of one row a merge: (it, l, r, segs), over `start`: (s, n)."""
    pairs = f"SELECT t[i] AS l, t[i + 1] AS r, sum(n) AS c FROM (SELECT {_opened('x.s')} AS t, x.n AS n FROM (SELECT unnest(p.segs) AS x)), LATERAL (SELECT unnest(range(1, len(t))) AS i) GROUP BY 1, 2"
    best = f"SELECT l, r FROM ({pairs}) WHERE c >= {least} ORDER BY c DESC, l, r LIMIT 1"
    step = "list_transform(p.segs, lambda x: {'s': replace(x.s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)), 'n': x.n})"
    return f"""loop(it, l, r, segs) AS (
        SELECT 0, NULL::VARCHAR, NULL::VARCHAR, list({{'s': s, 'n': n}}) FROM {start}
        UNION ALL
        SELECT p.it + 1, b.l, b.r, {step} FROM loop p, LATERAL ({best}) b WHERE p.it < {limit})"""


_BPE = f"WITH RECURSIVE {WORDS}, start AS (SELECT {_wrapped(_CHARS.format('word'))} AS s, n FROM words), {_loop('start', '20')}"
_FINAL = "final AS (SELECT x.s AS s, x.n AS n FROM (SELECT unnest(segs) AS x FROM loop WHERE it = (SELECT max(it) FROM loop)))"
# the words ride along with their segmentations, in one order
_BPE_WORDS = f"""{_BPE}, rules AS (SELECT list({{'p': chr(1) || l || chr(2) || chr(1) || r || chr(2), 'm': chr(1) || l || r || chr(2)}} ORDER BY it) AS rs FROM loop WHERE it > 0),
    done AS (SELECT word, n, list_reduce(list_prepend({{'p': '', 'm': s}}, rs), lambda a, b: {{'p': '', 'm': replace(a.m, b.p, b.m)}}).m AS s
             FROM (SELECT word, n, {_wrapped(_CHARS.format('word'))} AS s FROM words), rules)"""
_SP_START = f"""start AS (SELECT {_wrapped("list_transform(string_split(s, ''), lambda c: CASE WHEN list_contains(al, c) THEN c ELSE '<unk>' END)")} AS s, n FROM marked, (SELECT list(ch) AS al FROM cut))"""


def _sp(size: int) -> str:
    """Merges until the vocabulary has `size` entries; every merge of these data adds one."""
    return f"WITH RECURSIVE {CHARS}{_CUT.format('0.9995')}, {_SP_START}, {_loop('start', f'({size} - 1 - (SELECT count(*) FROM cut))')}"


_SEEDED = CHARS + """, pieces AS (SELECT s, n, unnest(range(1, length(s) + 1)) AS i FROM marked),
    grams AS (SELECT substr(s, i, 16) AS w, sum(n)::BIGINT AS n FROM pieces GROUP BY 1),
    subs AS (SELECT substr(w, 1, k) AS token, sum(n)::BIGINT AS c FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS k FROM grams) GROUP BY 1)"""
_WP_SINGLE = f"single AS ({_TOKENS.format(_PIECES, 'words')})"
_WP_PAIRS = f"pairs AS ({_PAIRS.format(_PIECES, 'words')})"
_JOIN_PAIR = "l || CASE WHEN r LIKE '##%' THEN substr(r, 3) ELSE r END"
_GREEDY = f"""WITH RECURSIVE {WORDS}, {_WP_SINGLE}, {_WP_PAIRS},
    vocab AS (SELECT token FROM single WHERE c >= 50 UNION SELECT {_JOIN_PAIR} FROM (SELECT l, r FROM pairs ORDER BY c DESC, l, r LIMIT 200)),
    longest AS (SELECT max(length(token)) AS k FROM vocab),
    cands AS (SELECT word, st, max(en) AS en FROM (
                SELECT word, st, en, CASE WHEN st > 1 THEN '##' ELSE '' END || substr(word, st, en - st + 1) AS token
                FROM (SELECT word, st, unnest(range(st, least(length(word), st + (SELECT k FROM longest) - 1) + 1)) AS en
                      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS st FROM words)))
              SEMI JOIN vocab USING (token) GROUP BY word, st),
    walk(word, pos, out) AS (SELECT word, 1::BIGINT, []::VARCHAR[] FROM words
        UNION ALL SELECT k.word, c.en + 1, list_append(k.out, CASE WHEN c.st > 1 THEN '##' ELSE '' END || substr(k.word, c.st, c.en - c.st + 1))
        FROM walk k JOIN cands c ON c.word = k.word AND c.st = k.pos),
    greedy AS (SELECT w.word, w.n, coalesce(k.out, ['[UNK]']) AS tokens FROM words w LEFT JOIN walk k ON k.word = w.word AND k.pos = length(w.word) + 1)"""

_WP_LOOP = f"""WITH RECURSIVE {WORDS}, start AS (SELECT {_wrapped(_PIECES)} AS s, n FROM words),
    loop(it, l, r, segs) AS (
        SELECT 0, NULL::VARCHAR, NULL::VARCHAR, list({{'s': s, 'n': n}}) FROM start
        UNION ALL
        SELECT p.it + 1, b.l, b.r, list_transform(p.segs, lambda x: {{'s': replace(x.s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || (CASE WHEN b.r LIKE '##%' THEN substr(b.r, 3) ELSE b.r END) || chr(2)), 'n': x.n}})
        FROM loop p, LATERAL (
            SELECT x.l AS l, x.r AS r FROM (
                SELECT unnest(ps) AS x, cs FROM (
                    SELECT list({{'l': l, 'r': r, 'c': c}}) FILTER (WHERE r IS NOT NULL AND c >= 2) AS ps, map(list(l) FILTER (WHERE r IS NULL), list(c) FILTER (WHERE r IS NULL)) AS cs FROM (
                        SELECT e.l AS l, e.r AS r, sum(n) AS c FROM (
                            SELECT unnest(list_concat(list_transform(range(1, len(t)), lambda i: {{'l': t[i], 'r': t[i + 1]}}), list_transform(t, lambda y: {{'l': y, 'r': NULL::VARCHAR}}))) AS e, n
                            FROM (SELECT {_opened('x.s')} AS t, x.n AS n FROM (SELECT unnest(p.segs) AS x)))
                        GROUP BY 1, 2)))
            ORDER BY x.c::DOUBLE / (cs[x.l]::DOUBLE * cs[x.r]::DOUBLE) DESC, x.l, x.r LIMIT 1) b WHERE p.it < 10)"""

#: Where characters of marked sentences, and pieces of words, stand first.
_FIRST_CHARS = rf"""firsts AS (SELECT ch, min({{'d': doc_id, 'l': l, 'p': p}}) AS seen FROM (SELECT doc_id, l, unnest(range(length(s))) AS p, unnest(string_split(s, '')) AS ch FROM (
        SELECT doc_id, l, {_MARK} AS s FROM (SELECT doc_id, l, regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '') AS sentence FROM (
            SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS l, unnest(string_split(text, chr(10))) AS v FROM documents))
        WHERE sentence <> '' AND sentence NOT LIKE '#%') WHERE s <> '') GROUP BY ch)"""
_FIRST_PIECES = rf"""firsts AS (SELECT token, min({{'d': doc_id, 'w': w, 'p': p}}) AS seen FROM (SELECT doc_id, w, unnest(range(length(word))) AS p, unnest({_PIECES}) AS token FROM (
        SELECT doc_id, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS w, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '') GROUP BY token)"""


def _start(most: int, seeded: str = _SEEDED) -> str:
    """The seed model of at most `most` pieces, and the numbered sentences."""
    return f"""WITH RECURSIVE {seeded},
    seeds AS (SELECT token, row_number() OVER (ORDER BY k, c DESC, token) - 1 AS id FROM (
              SELECT 0 AS k, 0 AS c, ch AS token FROM chars UNION ALL (SELECT 1, c, token FROM subs WHERE length(token) > 1 ORDER BY c DESC, token LIMIT (SELECT {most} - count(*) FROM chars)))),
    model0 AS MATERIALIZED (SELECT id, token, -ln((SELECT count(*) FROM seeds)) AS lp FROM seeds),
    numbered AS MATERIALIZED (SELECT row_number() OVER () AS sid, s, n, length(s) AS len FROM marked)"""


def _viterbi(i: int) -> str:
    """Best paths under model{i}. Every character is a piece, so every place is reached. Of equal scores the
    longest last piece wins; a place keeps the scores of the sixteen places before it."""
    return f""", hits{i} AS (SELECT sid, e, k, lp FROM (
        SELECT sid, e, k, substr(s, e - k + 1, k) AS token FROM (SELECT sid, s, e, unnest(range(1, least(e, longest) + 1)) AS k
        FROM (SELECT sid, s, unnest(range(1, len + 1)) AS e FROM numbered), (SELECT max(length(token)) AS longest FROM model{i})))
        JOIN model{i} USING (token)),
    edges{i} AS MATERIALIZED (SELECT sid, e, list(k ORDER BY k DESC) AS ks, list(lp ORDER BY k DESC) AS lps FROM hits{i} GROUP BY sid, e),
    walk{i}(sid, e, w, k) AS (SELECT sid, 0::BIGINT, [0.0::DOUBLE], 0::BIGINT FROM numbered
        UNION ALL
        SELECT sid, e, list_prepend(c[b], w[1:15]), ks[b] FROM (SELECT sid, e, w, ks, c, list_position(c, list_max(c)) AS b FROM (
            SELECT r.sid, x.e, r.w, x.ks, list_transform(x.ks, lambda k, j: r.w[k] + x.lps[j]) AS c FROM walk{i} r JOIN edges{i} x ON x.sid = r.sid AND x.e = r.e + 1))),
    walked{i} AS MATERIALIZED (SELECT sid, e, k, w[1] AS lp FROM walk{i}),
    back{i}(sid, e, k) AS (SELECT sid, e, k FROM walked{i} JOIN numbered USING (sid) WHERE e = len
        UNION ALL
        SELECT b.sid, x.e, x.k FROM back{i} b JOIN walked{i} x ON x.sid = b.sid AND x.e = b.e - b.k AND x.e > 0),
    parts{i} AS MATERIALIZED (SELECT sid, e, n, substr(s, e - k + 1, k) AS token FROM back{i} JOIN numbered USING (sid)),
    counts{i} AS MATERIALIZED (SELECT token, sum(n)::DOUBLE AS c FROM parts{i} GROUP BY token)"""


def _maximised(i: int, name: str) -> str:
    return f""", {name} AS MATERIALIZED (SELECT id, token, coalesce(c, 0) AS c, ln((coalesce(c, 0) + 1e-10) / ((SELECT sum(c) FROM counts{i}) + 1e-10 * (SELECT count(*) FROM model{i}))) AS lp
        FROM model{i} LEFT JOIN counts{i} USING (token))"""


def _pruned(source: str, name: str, gone: str) -> str:
    """Without the unprotected pieces of smallest |c lp|, `gone` of them."""
    return f""", {name} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS id, token, lp FROM (
        SELECT id, token, lp, loose, row_number() OVER (PARTITION BY loose ORDER BY abs(c * lp), id) AS place FROM (SELECT *, length(token) > 1 AND token NOT LIKE '<%' AS loose FROM {source}))
        WHERE NOT (loose AND place <= {gone}))"""


def _trained(most: int, target: int, rounds: int) -> str:
    """EM and pruning of words as lines up to `rounds` times, each of which does nothing once the target is
    reached, then EM."""
    sql = _start(most, _SEEDED.replace(MARKED, WORDS + ", marked AS (SELECT '▁' || word AS s, n FROM words)"))
    for i in range(rounds):
        size = f"(SELECT count(*) FROM model{i})"
        sql += _viterbi(i) + _maximised(i, f"em{i}") + _pruned(f"em{i}", f"less{i}", f"trunc({size} * 0.2::DOUBLE)")
        sql += f", model{i + 1} AS MATERIALIZED (SELECT * FROM less{i} WHERE {size} > {target} UNION ALL SELECT * FROM model{i} WHERE {size} <= {target})"
    return sql + _viterbi(rounds) + _maximised(rounds, "final")


_UNIGRAM = _start(400) + _viterbi(0)
# sentences with a character that the model lacks have no path
_KNOWN = (
    _start(400).replace("model0 AS MATERIALIZED (SELECT id, token, -ln((SELECT count(*) FROM seeds)) AS lp FROM seeds)", """rare AS (SELECT list(ch) AS chs FROM chars WHERE c < 200),
    known AS (SELECT id, token FROM seeds, rare WHERE NOT list_has_any(string_split(token, ''), coalesce(chs, []))),
    model0 AS MATERIALIZED (SELECT id, token, -ln((SELECT count(*) FROM known)) AS lp FROM known)""").replace("numbered AS MATERIALIZED (", "sentences0 AS MATERIALIZED (")
    + """, letters AS MATERIALIZED (SELECT sid, n, unnest(range(len)) AS p, unnest(string_split(s, '')) AS token FROM sentences0),
    lost AS MATERIALIZED (SELECT sid, string_agg(token, '|' ORDER BY p) AS tokens, sum(coalesce(lp, -100)) AS lp FROM letters LEFT JOIN model0 USING (token) GROUP BY sid HAVING count(*) > count(lp)),
    numbered AS MATERIALIZED (SELECT * FROM sentences0 ANTI JOIN lost USING (sid))"""
    + _viterbi(0)
)
_EM = _UNIGRAM + _maximised(0, "em")
_LIKELIHOOD = "(SELECT sum(lp * n) FROM walked{0} JOIN numbered USING (sid) WHERE e = len)"

ORACLES: dict[str, str] = {
    "scan_words": f"WITH {LINES} SELECT word, count(*)::BIGINT AS n FROM (SELECT regexp_split_to_array(value, '\\s+')[1] AS word FROM lines WHERE value <> '' AND value NOT LIKE '#%') GROUP BY word",
    "scan_sentences": f"WITH {SENTENCES} SELECT sentence, n FROM sentences",
    "scan_limit": r"""SELECT doc_id, line_no, value FROM (
        SELECT doc_id, line_no, regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '') AS value FROM (
            SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS v FROM documents))
        WHERE value <> '' AND value NOT LIKE '#%' ORDER BY doc_id, line_no LIMIT 50""",
    "pair_counts_top": f"WITH {WORDS} SELECT * FROM ({_PAIRS.format(_CHARS.format('word'), 'words')}) WHERE c >= 2 ORDER BY c DESC, l, r LIMIT 20",
    "pair_counts_all": f"WITH {WORDS} {_PAIRS.format(_CHARS.format('word'), 'words')}",
    "wordpiece_pretokenize": f"WITH {WORDS} SELECT word, array_to_string({_PIECES}, '|') AS pieces FROM words",
    "wordpiece_token_counts": f"WITH {WORDS} {_TOKENS.format(_PIECES, 'words')}",
    "wordpiece_pair_scores": f"WITH {WORDS}, {_WP_SINGLE}, {_WP_PAIRS} SELECT l, r, p.c, round(p.c::DOUBLE / (a.c::DOUBLE * b.c::DOUBLE), 12) AS score, {_JOIN_PAIR} AS merged FROM pairs p JOIN single a ON a.token = l JOIN single b ON b.token = r WHERE p.c >= 2",
    "normalize_sentences": f"WITH {SENTENCES} SELECT sentence, {_MARK} AS marked FROM sentences",
    "corpus_stats_words": f"WITH {WORDS} SELECT sum(n)::BIGINT AS n_rows, sum(length(word) * n)::BIGINT AS n_chars, round(sum(length(word) * n)::DOUBLE / sum(n)::DOUBLE, 6) AS mean_chars FROM words",
    "corpus_stats_sentences": f"WITH {SENTENCES} SELECT sum(n)::BIGINT AS n_rows, sum(length(sentence) * n)::BIGINT AS n_chars, round(sum(length(sentence) * n)::DOUBLE / sum(n)::DOUBLE, 6) AS mean_chars FROM sentences",
    "character_frequency": f"WITH {CHARS} SELECT ch, c FROM chars",
    "character_coverage": f"WITH {CHARS}{_CUT.format('0.99')} SELECT ch, c FROM cut",
    "covered_sentences": f"WITH {CHARS}{_CUT.format('0.99')} SELECT token, sum(c)::BIGINT AS c FROM (SELECT CASE WHEN ch IN (SELECT ch FROM cut) THEN ch ELSE '<unk>' END AS token, c FROM chars) GROUP BY token",
    "first_seen_vocabulary": r"""SELECT row_number() OVER (ORDER BY doc_id, w, pos) - 1 AS token_id, token FROM (
        SELECT token, doc_id, w, pos FROM (
            SELECT doc_id, w, unnest(range(length(word))) AS pos, unnest(string_split(word, '')) AS token FROM (
                SELECT doc_id, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS w, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '')
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY doc_id, w, pos) = 1)""",
    "packed_pairs": f"WITH {WORDS}, p AS (SELECT DISTINCT unicode(l)::BIGINT AS a, unicode(r)::BIGINT AS b FROM ({_PAIRS.format(_CHARS.format('word'), 'words')})) SELECT a, b, a * 4294967296 + b AS packed, a AS left, b AS right FROM p",
    "seed_substrings": f"WITH {_SEEDED} SELECT token, c FROM subs WHERE length(token) > 1 ORDER BY c DESC, token LIMIT 300",
    "bpe_train": f"{_BPE} SELECT (it - 1)::INTEGER AS rank, l, r FROM loop WHERE it > 0",
    "bpe_train_distributed": f"{_BPE} SELECT (it - 1)::INTEGER AS rank, l, r FROM loop WHERE it > 0",
    "bpe_tokenize": f"{_BPE_WORDS} SELECT word, array_to_string({_opened('s')}, '|') AS tokens FROM done",
    "bpe_token_frequencies": f"{_BPE}, {_FINAL} {_TOKENS.format(_opened('s'), 'final')}",
    "bpe_tokens_per_word": f"{_BPE}, {_FINAL} SELECT round(sum(len({_opened('s')}) * n)::DOUBLE / sum(n)::DOUBLE, 6) AS tokens_per_word FROM final",
    "top_tokens": f"{_BPE}, {_FINAL} SELECT * FROM ({_TOKENS.format(_opened('s'), 'final')}) ORDER BY c DESC, token LIMIT 20",
    "dump_rules": f"{_BPE} SELECT (it - 1)::INTEGER AS line_no, l || chr(9) || r AS line FROM loop WHERE it > 0",
    "dump_vocabulary": f"{_sp(100)}, {_FIRST_CHARS} SELECT (row_number() OVER (ORDER BY k, seen) - 1)::INTEGER AS line_no, token AS line FROM (SELECT 0 AS k, NULL AS seen, '<unk>' AS token UNION ALL SELECT 1, seen, ch FROM cut JOIN firsts USING (ch) UNION ALL SELECT 1 + it, NULL, l || r FROM loop WHERE it > 0)",
    "dump_log_probs": f"{_start(400)}, dumped AS (SELECT token || chr(9) || printf('%.6f', lp) AS line FROM model0) SELECT (row_number() OVER (ORDER BY line) - 1)::INTEGER AS line_no, line FROM dumped",
    "sentence_bpe_train": f"{_sp(90)} SELECT (it - 1)::INTEGER AS rank, l, r, l || r AS merged FROM loop WHERE it > 0",
    "sentence_bpe_vocabulary": f"{_sp(100)}, {_FIRST_CHARS} SELECT (row_number() OVER (ORDER BY k, seen) - 1)::INTEGER AS token_id, token FROM (SELECT 0 AS k, NULL AS seen, '<unk>' AS token UNION ALL SELECT 1, seen, ch FROM cut JOIN firsts USING (ch) UNION ALL SELECT 1 + it, NULL, l || r FROM loop WHERE it > 0)",
    "sentence_bpe_frequencies": f"{_sp(100)}, {_FINAL} {_TOKENS.format(_opened('s'), 'final')}",
    "wordpiece_train": f"{_WP_LOOP} SELECT (it - 1)::INTEGER AS rank, l, r, l || CASE WHEN r LIKE '##%' THEN substr(r, 3) ELSE r END AS merged FROM loop WHERE it > 0",
    "wordpiece_train_distributed": f"{_WP_LOOP} SELECT (it - 1)::INTEGER AS rank, l, r, {_JOIN_PAIR} AS merged FROM loop WHERE it > 0",
    "wordpiece_vocabulary": f"{_WP_LOOP}, {_FIRST_PIECES} SELECT (row_number() OVER (ORDER BY k, seen) - 1)::INTEGER AS token_id, token FROM (SELECT 0 AS k, seen, token FROM firsts UNION ALL SELECT it, NULL, {_JOIN_PAIR} FROM loop WHERE it > 0)",
    "sentence_bpe_train_distributed": f"{_sp(90)} SELECT (it - 1)::INTEGER AS rank, l, r, l || r AS merged FROM loop WHERE it > 0",
    "wordpiece_tokenize": f"{_GREEDY} SELECT word, array_to_string(tokens, '|') AS tokens FROM greedy",
    "wordpiece_frequencies": f"{_GREEDY} {_TOKENS.format('tokens', 'greedy')}",
    "unigram_seed": f"WITH {_SEEDED}, v AS (SELECT ch AS token FROM chars UNION ALL (SELECT token FROM subs WHERE length(token) > 1 ORDER BY c DESC, token LIMIT (SELECT 400 - count(*) FROM chars))) SELECT token, round(-ln(count(*) OVER ()), 6) AS log_prob FROM v",
    "unigram_tokenize": f"""{_UNIGRAM} SELECT s, tokens, round(lp, 6) AS lp FROM (SELECT sid, string_agg(token, '|' ORDER BY e) AS tokens FROM parts0 GROUP BY sid)
        JOIN numbered USING (sid) JOIN (SELECT sid, e AS len, lp FROM walked0) USING (sid, len)""",
    "unigram_frequencies": f"{_UNIGRAM} SELECT token, c::BIGINT AS c FROM counts0",
    "unigram_em_step": f"{_EM} SELECT token, c, round(lp, 6) AS log_prob FROM em",
    "unigram_log_likelihood": f"{_EM}, model1 AS (SELECT id, token, lp FROM em){_viterbi(1)} SELECT round({_LIKELIHOOD.format(0)}, 3) AS before, round({_LIKELIHOOD.format(1)}, 3) AS after",
    "unigram_prune": f"{_EM}{_pruned('em', 'less', 'trunc((SELECT count(*) FROM em) * 0.2::DOUBLE)')} SELECT id::INTEGER AS token_id, token, round(lp, 6) AS log_prob FROM less",
    "unigram_fallback": f"""{_KNOWN} SELECT s, tokens, round(lp, 6) AS lp FROM (SELECT sid, string_agg(token, '|' ORDER BY e) AS tokens FROM parts0 GROUP BY sid)
        JOIN numbered USING (sid) JOIN (SELECT sid, e AS len, lp FROM walked0) USING (sid, len) UNION ALL SELECT s, tokens, round(lost.lp, 6) FROM lost JOIN sentences0 USING (sid)""",
    "unigram_known_counts": f"{_KNOWN} SELECT token, sum(n)::BIGINT AS c FROM (SELECT token, n FROM parts0 UNION ALL SELECT token, n FROM letters SEMI JOIN lost USING (sid) SEMI JOIN model0 USING (token)) GROUP BY token",
    "unigram_train": f"{_trained(600, 300, 4)} SELECT id::INTEGER AS token_id, token, round(lp, 6) AS log_prob, length(token) = 1 OR token LIKE '<%' AS protected FROM final",
    "protected_tokens": f"WITH {WORDS} SELECT word, length(word) = 1 OR word LIKE '<%' AS protected FROM words",
}
