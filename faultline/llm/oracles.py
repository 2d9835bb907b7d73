"""DuckDB SQL for the queries that SQL can express (the others have brute-force tests)."""

from __future__ import annotations

_QUALITY = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM t),
win AS (SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             n_symbols * 1000 // greatest(n_words, 1) AS sym, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup,
             n_repeat_words * 1000 // greatest(n_words, 1) AS rep, word_chars * 100 // greatest(n_words, 1) AS wl
      FROM m),
v AS (SELECT lang, source, measure, x,
             greatest(length(bin(x)) - 8, 0) AS s
      FROM (UNPIVOT (SELECT lang, source, sym, dup, rep, wl FROM b WHERE NOT base_failed)
            ON sym, dup, rep, wl INTO NAME measure VALUE x)),
h AS (SELECT lang, source, measure, (x >> s) << s AS bin, count(*) AS n FROM v GROUP BY ALL),
lv AS (SELECT 0 AS level, lang, source, measure, bin, n FROM h
       UNION ALL SELECT 1, lang, NULL, measure, bin, n FROM h
       UNION ALL SELECT 2, NULL, NULL, measure, bin, n FROM h),
hh AS (SELECT level, lang, source, measure, bin, sum(n) AS n FROM lv GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS seen,
             sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM hh),
q AS (SELECT level, lang, source, measure, max(total) AS total,
             min(bin) FILTER (WHERE seen * 4 >= total) AS q1, min(bin) FILTER (WHERE seen * 4 >= 3 * total) AS q3
      FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM h),
pick AS (SELECT g.lang, g.source, q.measure, min_by({'q1': q.q1, 'q3': q.q3}, q.level) AS q
         FROM g JOIN q ON (q.level = 0 AND q.lang IS NOT DISTINCT FROM g.lang AND q.source IS NOT DISTINCT FROM g.source)
                       OR (q.level = 1 AND q.lang IS NOT DISTINCT FROM g.lang) OR q.level = 2
         WHERE q.total >= 20 OR q.level = 2 GROUP BY ALL),
f AS (SELECT lang, source,
             max(q.q3 + greatest(3 * (q.q3 - q.q1), 100)) FILTER (WHERE measure = 'sym') AS hi_sym,
             max(q.q3 + greatest(3 * (q.q3 - q.q1), 300)) FILTER (WHERE measure = 'dup') AS hi_dup,
             max(q.q3 + greatest(3 * (q.q3 - q.q1), 100)) FILTER (WHERE measure = 'rep') AS hi_rep,
             max(q.q3 + greatest(3 * (q.q3 - q.q1), 400)) FILTER (WHERE measure = 'wl') AS hi_wl,
             max(q.q1 - greatest(3 * (q.q3 - q.q1), 200)) FILTER (WHERE measure = 'wl') AS lo_wl
      FROM pick GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(sym <= hi_sym, true) AND coalesce(dup <= hi_dup, true)
       AND coalesce(rep <= hi_rep, true) AND coalesce(wl <= hi_wl, true) AND coalesce(wl >= lo_wl, true) AS kept
FROM b LEFT JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u, min(v) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
       coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.u = w.doc_id
"""

_CLEAN = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i
             FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

_SPANS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS kept
         FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) t
         ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_BYTES = r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g, md5_number_lower(substr(h, 2 * i + 1, 100)) AS g2
        FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM w WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g, g2) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
edge AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone),
n AS (SELECT doc_id, count(*) AS n, count(DISTINCT run) AS spans FROM edge GROUP BY 1),
kept AS (SELECT t.doc_id, string_agg(substr(h, 2 * t.p + 1, 2), '' ORDER BY t.p) AS kept
         FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM w) t
         ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY 1)
SELECT w.doc_id, w.n::BIGINT AS n_bytes, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(n.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_PREFER = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
           FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                 FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT conv_id, max(p) AS k, max_by(text, p) AS reply FROM t WHERE role = 'assistant' GROUP BY 1),
nx AS (SELECT conv_id, k, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other FROM k),
pair AS (SELECT a.conv_id, a.k, b.reply FROM nx a JOIN k b ON b.conv_id = a.other),
s AS (SELECT t.conv_id, 'c' AS side, p, role, text FROM t JOIN pair USING (conv_id)
      UNION ALL SELECT t.conv_id, 'r', p, role, CASE WHEN p = k THEN reply ELSE text END FROM t JOIN pair USING (conv_id) WHERE p <= k),
d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.p, b.p)) AS p
      FROM (SELECT * FROM s WHERE side = 'c') a FULL JOIN (SELECT * FROM s WHERE side = 'r') b ON a.conv_id = b.conv_id AND a.p = b.p
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
l AS (SELECT s.conv_id, coalesce(max(d.p) - 1, max(s.p)) AS n FROM s LEFT JOIN d USING (conv_id) GROUP BY 1),
r AS (SELECT s.*, l.n, '<|' || role || '|>' || chr(10) || text || chr(10) AS body,
             sum(length(role) + length(text) + 6) OVER (PARTITION BY s.conv_id, side, s.p > l.n ORDER BY s.p) AS stop
      FROM s JOIN l USING (conv_id)),
g AS (SELECT conv_id, max(n)::BIGINT AS n_prompt_turns,
             coalesce(string_agg(body, '' ORDER BY p) FILTER (WHERE side = 'c' AND p <= n), '') AS prompt,
             coalesce(string_agg(body, '' ORDER BY p) FILTER (WHERE side = 'c' AND p > n), '') AS c,
             coalesce(string_agg(body, '' ORDER BY p) FILTER (WHERE side = 'r' AND p > n), '') AS r,
             coalesce(string_agg((stop - length(text) - 1)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY p)
                      FILTER (WHERE side = 'c' AND p > n AND role = 'assistant'), '') AS cs,
             coalesce(string_agg((stop - length(text) - 1)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY p)
                      FILTER (WHERE side = 'r' AND p > n AND role = 'assistant'), '') AS rs
      FROM r GROUP BY 1)
SELECT conv_id, n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(c) AS chosen_sha256, cs AS chosen_spans,
       sha256(r) AS rejected_sha256, rs AS rejected_spans FROM g
UNION ALL
SELECT conv_id, count(*), sha256(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY p)), sha256(''), '', NULL, NULL
FROM t ANTI JOIN k USING (conv_id) GROUP BY conv_id
"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31)::INT + 1, 1)"
    for at in range(0, 40, 10) for k in range(8))

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f < page_id THEN f END AS refers_to
FROM d
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, unsigned (bit by bit; DuckDB has no such function)."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    bits = "lambda x, z: xor(x >> 1, (x & 1) * 3988292384)"
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bits})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RUNS = f"""
WITH t AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS hit FROM t),
a AS (SELECT *, CASE WHEN hit THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws
      FROM p),
u AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
r AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e)
      GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
q AS (SELECT doc_id, s, len, min(p) AS p FROM r GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM q),
kept AS (SELECT u.doc_id, string_agg(w, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs,
             min({{'l': -len, 's': s, 'p': p}}) AS best FROM q GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * -best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# a space stands for the begin mark and a line feed for the end: no word holds them
_SCORES = f"""
WITH t AS (SELECT doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held, {_SPLIT.format(_LOWER)} AS ws FROM documents),
u AS (SELECT doc_id, held, unnest(list_concat([' '], ws, [chr(10)])) AS w, unnest(range(len(ws) + 2)) AS i FROM t),
x AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM u),
c1 AS (SELECT w, count(*) AS c FROM x WHERE NOT held GROUP BY 1),
c2 AS (SELECT a, w, count(*) AS c FROM x WHERE NOT held AND i >= 1 GROUP BY 1, 2),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1 WHERE w <> ' '),
p1 AS (SELECT x.doc_id, x.held, n.n, coalesce(w1.c, 0) AS w1, coalesce(a1.c, 0) AS a1, coalesce(w2.c, 0) AS w2,
              (coalesce(w1.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)) AS p1
       FROM x CROSS JOIN n LEFT JOIN c1 w1 ON w1.w = x.w LEFT JOIN c1 a1 ON a1.w = x.a LEFT JOIN c2 w2 ON w2.a = x.a AND w2.w = x.w
       WHERE x.i >= 1),
p2 AS (SELECT *, (w2 + 256.0::DOUBLE * p1) / (a1 + 256.0::DOUBLE) AS p2 FROM p1)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE w1 > 0) AS n_known, max(n) AS train_tokens,
       round(fsum(log10(p1)), 6) AS base_score, round(fsum(log10(p2)), 6) AS score
FROM p2 GROUP BY doc_id, held
"""


def _cheapest() -> str:
    """The four grammar states' (cost, audit) before a row, from those behind it (``f``) and the row's letter (``c``)."""
    inserted = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def best(state: int) -> str:
        moves = []
        for at, m in inserted[state]:
            def move(price: str, name: str, to: int, m=m) -> str:
                return f"{{'c': f.f[{to + 1}].c + {2 * m} + {price}, 'a': '{'I' * m}{name}' || f.f[{to + 1}].a}}"
            late = "CASE WHEN f.l >= 'A' AND f.l <= 'Z' THEN 1 ELSE 0 END"
            moves.append(move("3", "D", at))
            for r in "sua":
                if (at, r) in step:
                    moves.append(move(f"CASE WHEN lower(f.l) <> '{r}' THEN 9999999 ELSE {late} END", "K", step[at, r]))
                    if r != "s":
                        moves.append(move(f"CASE WHEN f.l = 'D' THEN 9999999 ELSE 2 + {late} END", "R", step[at, r]))
        return f"list_sort([{', '.join(moves)}])[1]"
    return f"[{', '.join(best(s) for s in range(4))}]"


_REPAIR = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM c WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS x FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                     WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN fault = 'truncated' THEN upper(x) ELSE x END AS letter,
             lead(x) OVER (PARTITION BY conv_id ORDER BY p) AS after, count(*) OVER (PARTITION BY conv_id) AS rows FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE after IS NOT NULL AND x || after NOT IN ('su', 'ua', 'au')) AS illegal,
             string_agg(letter, '' ORDER BY p) AS letters, list({{'role': role, 'text': text}} ORDER BY p) AS body
      FROM l GROUP BY 1),
w AS (SELECT letters, length(letters) AS pos, [{{'c': 0::INTEGER, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS f
      FROM (SELECT DISTINCT letters FROM g)
      UNION ALL SELECT letters, pos - 1, {_cheapest()} FROM (SELECT letters, pos, f, substr(letters, pos, 1) AS l FROM w) f WHERE f.pos > 0),
b AS (SELECT g.*, w.f[1].c::BIGINT AS cost, w.f[1].a AS audit FROM g JOIN w ON w.letters = g.letters AND w.pos = 0),
m AS (SELECT conv_id, body, unnest(string_split(audit, '')) AS name, unnest(range(length(audit))) AS j FROM b WHERE audit <> ''),
o AS (SELECT conv_id, name, j, body[count(*) FILTER (WHERE name <> 'I') OVER z] AS own, count(*) FILTER (WHERE name <> 'D') OVER z AS nth,
             count(*) FILTER (WHERE name <> 'D') OVER z - CASE WHEN max(CASE WHEN name = 'K' AND nth0 = 1 AND own0 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1 THEN 1 ELSE 0 END AS place
      FROM (SELECT *, count(*) FILTER (WHERE name <> 'D') OVER z AS nth0,
                   substr(body[count(*) FILTER (WHERE name <> 'I') OVER z].role, 1, 1) AS own0 FROM m WINDOW z AS (PARTITION BY conv_id ORDER BY j)) m
      WINDOW z AS (PARTITION BY conv_id ORDER BY j)),
h AS (SELECT conv_id, string_agg(CASE WHEN name = 'K' THEN own.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                                 || CASE WHEN name = 'I' THEN '' ELSE own.text END, chr(10) ORDER BY j) AS made
      FROM o WHERE name <> 'D' GROUP BY 1),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(made, '')) AS repaired_sha256
FROM i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": _CLEAN,
    "op2_substring_dedup": _SPANS,
    "op3_suffix_array_dedup": _BYTES,
    "op5_warc": _WARC,
    "op6_quality_rules": _QUALITY,
    "op9_preference_formatting": _PREFER,
    "op8_minhash_near_dedup": _NEAR,
    "op11_periodic_runs": _RUNS,
    "op12_lm_scores": _SCORES,
    "op13_structure_repair": _REPAIR,
}
