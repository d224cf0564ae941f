"""DuckDB SQL of the training-data queries that SQL can express. XXH64 and trained models are beyond it: op1, op5, op6, op9."""

from __future__ import annotations

from . import chat, mixing, quality, units, winnow

ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({ASCII.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of equal length meet by their words.
DECONTAMINATE = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 p AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) u(i)),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 h AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM p), unnest(range(1, len(w) - k + 2)) u(i)) JOIN p USING (k, g)),
 n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

_ESCAPED = "replace(replace({0}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
_SIZE = len(chat.START) + len(chat.END) + 2

#: Spans start where a running total overflows: the next start of every turn is found first, then followed from turn 0.
CHAT = f"""WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 t AS (SELECT *, row_number() OVER w - 1 AS i, sum(k) OVER w - k AS p, sum(c) OVER w - c AS at, first(role) OVER w = 'system' AS sys FROM (
   SELECT *, len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.OVERHEAD} AS k, {_SIZE} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) AS c FROM a) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 f AS (SELECT conv_id, CAST(any_value(sys) AS INT) AS y, CASE WHEN any_value(sys) THEN min_by(k, i) ELSE 0 END AS sk, CASE WHEN any_value(sys) THEN min_by(c, i) ELSE 0 END AS sc, count(*) AS n, sum(c) AS total,
   greatest(1, {chat.BUDGET - chat.HISTORY} - CASE WHEN any_value(sys) THEN min_by(k, i) ELSE 0 END) AS room FROM t GROUP BY conv_id),
 x AS (SELECT b.conv_id, b.i AS b, min(t.i) AS nxt FROM t b JOIN f USING (conv_id) JOIN t o ON o.conv_id = b.conv_id AND o.i = least(n - 1, CASE WHEN b.i = 0 THEN y ELSE b.i END)
   JOIN t ON t.conv_id = b.conv_id AND t.i > o.i AND t.p + t.k - o.p > room GROUP BY b.conv_id, b.i),
 s AS (SELECT conv_id, CAST(0 AS BIGINT) AS b FROM f UNION ALL SELECT s.conv_id, x.nxt FROM s JOIN x ON x.conv_id = s.conv_id AND x.b = s.b),
 e AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY conv_id ORDER BY b), n) AS e FROM s JOIN f USING (conv_id)),
 g AS (SELECT e.conv_id, e.b, any_value(CASE WHEN e.b > 0 THEN sc ELSE 0 END) AS head, any_value(coalesce(z.at, total)) - min(h.at) AS body FROM e JOIN t c ON c.conv_id = e.conv_id AND c.i = e.b
   JOIN t h ON h.conv_id = e.conv_id AND (h.i = e.b OR (e.b > 0 AND h.i >= y AND h.i < e.b AND h.i >= e.b - {chat.HISTORY // chat.OVERHEAD} AND c.p - h.p <= {chat.HISTORY})) LEFT JOIN t z ON z.conv_id = e.conv_id AND z.i = e.e GROUP BY e.conv_id, e.b),
 w AS (SELECT conv_id, sum(head + body) AS chars, count(*) AS windows FROM g GROUP BY conv_id),
 q AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
 SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(windows AS BIGINT) AS n_windows FROM q JOIN w USING (conv_id)"""

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: A sentence ends at marks that white space follows; a byte that texts lack stands between units.
UNITS = f"""WITH l AS (SELECT doc_id, ord AS li, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - length(line) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
 u AS (SELECT doc_id, li, pos, unnest(string_split(m, chr(1))) AS unit, generate_subscripts(string_split(m, chr(1)), 1) AS ui FROM (SELECT *, regexp_replace(line, '([.!?…。]+)({_SPACE})', '\\1' || chr(1) || '\\2', 'g') AS m FROM l)),
 v AS (SELECT doc_id, li, ui, pos + sum(length(unit)) OVER (PARTITION BY doc_id, li ORDER BY ui) - length(unit) AS s, unit, trim(unit, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM u),
 n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY li, ui) - 1 AS i, s + length(unit) - length(ltrim(unit, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s, length(body) AS n,
   len(regexp_extract_all(body, '[^ \\t\\n\\x0B\\f\\r]+')) AS words, regexp_replace({ASCII.format('body')}, '{_SPACE}+', ' ', 'g') AS g FROM v WHERE body <> ''),
 f AS (SELECT g, min_by(doc_id, doc_id * 1000000 + i) AS first_doc_id, min(doc_id * 1000000 + i) AS first FROM n GROUP BY g HAVING count(*) > 1),
 r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n JOIN f USING (g) WHERE doc_id * 1000000 + i > first)
 SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(s + n) AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS n_units, CAST(sum(words) AS BIGINT) AS n_words, min_by(first_doc_id, i) AS first_doc_id FROM r GROUP BY doc_id, run HAVING sum(words) >= {units.MIN_WORDS}"""

_K, _L = winnow.WORDS, "trim(regexp_replace(line, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ')"
#: Windows of one to three lines that occurred earlier, merged where they touch.
LINES = f"""WITH l AS (SELECT doc_id, ord - 1 AS l, {_L} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) - 1 AS i, len(string_split(s, ' ')) AS c FROM l WHERE s <> ''),
 w AS (SELECT doc_id, i, l AS l0, CASE WHEN c >= {_K} THEN 1 WHEN c + lead(c) OVER o >= {_K} THEN 2 ELSE {winnow.LINES} END AS k, l, s, lead(l) OVER o AS la, lead(s) OVER o AS sa, lead(l, 2) OVER o AS lb, lead(s, 2) OVER o AS sb FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 v AS (SELECT doc_id, i, i + k - 1 AS e, l0, CASE k WHEN 1 THEN l WHEN 2 THEN la ELSE lb END AS l1, CASE k WHEN 1 THEN s WHEN 2 THEN s || chr(10) || sa ELSE s || chr(10) || sa || chr(10) || sb END AS g FROM w),
 f AS (SELECT g, min(doc_id * 1000000 + i) AS first, min_by(doc_id, doc_id * 1000000 + i) AS first_doc_id, min_by(l0, doc_id * 1000000 + i) AS first_line FROM v WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
 r AS (SELECT * FROM v JOIN f USING (g) WHERE doc_id * 1000000 + i > first),
 q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(e) OVER (PARTITION BY doc_id ORDER BY i) <= 1 THEN 0 ELSE 1 END AS fresh FROM r))
 SELECT doc_id, CAST(min(l0) AS BIGINT) AS start_line, CAST(max(l1) AS BIGINT) AS end_line, CAST(max(l1) - min(l0) + 1 AS BIGINT) AS n_lines, min_by(first_doc_id, i) AS first_doc_id, CAST(min_by(first_line, i) AS BIGINT) AS first_line FROM q GROUP BY doc_id, run"""


_PRIME = "CASE " + " ".join(f"WHEN nf % {p} <> 0 THEN {p}" for p in mixing.PRIMES) + " END"
#: Every seat is ranked here; the query ranks only those that the bracketing divisors leave open. Shards are runs of ranked seats, words are followed one by one over blocks.
MIX = f"""WITH d AS (SELECT *, md5(concat_ws(':', doc_id, size, md5(text), '{mixing.SEED}')) AS h FROM (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS size FROM documents)),
 s AS (SELECT source, sum(size) AS n, [{', '.join(f'{w}.0::DOUBLE' for w in mixing.WEIGHTS)}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM d GROUP BY source),
 f AS (SELECT *, {mixing.REPEAT} * CAST(n AS DOUBLE) AS cap, {mixing.REPEAT} * CAST(n AS DOUBLE) / w AS fill FROM s),
 l AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ow, sum(CAST(n AS DOUBLE)) OVER () - coalesce(sum(cap) OVER o, 0) AS lf FROM f WINDOW o AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT lf, ow FROM l WHERE lf / ow <= fill ORDER BY fill, source IS NULL, source LIMIT 1),
 t AS (SELECT source, n, CASE WHEN fill < v.lf / v.ow THEN cap ELSE v.lf * w / v.ow END AS target FROM l, v),
 b AS (SELECT *, CAST(greatest({mixing.LEAST_BLOCK}, ceil(sum(n) OVER () / {1 << 30}.0)) AS BIGINT) AS block FROM t),
 z AS (SELECT CAST(round(sum(n) / max(block)) AS BIGINT) AS seats, greatest(1, least({mixing.SHARDS}, CAST(round(sum(n) / max(block)) AS BIGINT) // {mixing.SHARD_BLOCKS})) AS shards FROM b),
 r AS (SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source IS NULL, source, seat) AS place FROM b, unnest(range(1, CAST({mixing.REPEAT} * ceil(n / block) AS BIGINT) + 1)) u(seat)),
 q AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY source ORDER BY k), 0) AS since FROM (SELECT y.source, k, count(place) AS upto FROM (SELECT b.source, k, CASE WHEN k = shards - 1 THEN seats ELSE CAST(floor(seats * (k + 1) / shards) AS BIGINT) END AS e FROM b, z, unnest(range(0, shards)) x(k)) y
   LEFT JOIN r ON r.source IS NOT DISTINCT FROM y.source AND place <= e GROUP BY ALL)),
 k AS (SELECT b.*, CAST(least(top * block, {mixing.REPEAT} * n) AS BIGINT) AS words, CAST(n // block AS BIGINT) AS nf, greatest(n // block, 1) AS np FROM b JOIN (SELECT source, max(upto) AS top FROM q GROUP BY source) g ON g.source IS NOT DISTINCT FROM b.source),
 m AS (SELECT *, {_PRIME} AS prime FROM k WHERE n > 0),
 p AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS a FROM d),
 x AS (SELECT doc_id, p.source, block, words, j * n + block * (CASE WHEN i < nf THEN ((i % np) * (prime % np) + {mixing.SEED} % np) % np ELSE nf END) + greatest(a, i * block) - i * block AS t, least(a + size, (i + 1) * block) - greatest(a, i * block) AS len
   FROM p JOIN m ON m.source IS NOT DISTINCT FROM p.source, unnest(range(a // block, CASE WHEN size > 0 THEN (a + size - 1) // block + 1 ELSE a // block END)) u(i), unnest(range({mixing.REPEAT})) w(j)),
 c AS (SELECT doc_id, k, sum(least(t + len, words, upto * block) - greatest(t, since * block)) AS part FROM x JOIN q ON q.source IS NOT DISTINCT FROM x.source AND greatest(t, since * block) < least(t + len, words, upto * block) GROUP BY doc_id, k),
 y AS (SELECT doc_id, sum(part) AS part, string_agg(k || ':' || CAST(part AS BIGINT), ',' ORDER BY k) AS shards FROM c GROUP BY doc_id)
 SELECT p.doc_id, p.source, CAST(p.size AS BIGINT) AS size, CAST(b.n AS BIGINT) AS source_size, b.target, CAST(coalesce(part, 0) AS BIGINT) AS taken, coalesce(shards, '') AS shards
 FROM p JOIN b ON b.source IS NOT DISTINCT FROM p.source LEFT JOIN y ON y.doc_id = p.doc_id"""


def quality_sql() -> str:
    """Statistics, starting quartiles, and each concentration step of both starts as a few common table expressions."""
    p, q = quality.P, quality
    name = lambda c: f"coalesce({c}, chr(0))"
    of = lambda make, sep=", ": sep.join(make(i) for i in range(p))
    low = [(i, j) for i in range(p) for j in range(i + 1)]
    n, chars = "CAST(greatest(n_words, 1) AS DOUBLE)", "CAST(greatest(word_chars, 1) AS DOUBLE)"
    root = lambda share: f"asin(sqrt(least(1.0, {share})))"
    count = lambda pattern: f"CAST(length(regexp_replace(coalesce(text, ''), '{pattern}', '', 'g')) AS BIGINT)"
    signs, upper = q.NO_SIGN.replace("\\x09-\\x0D", "\\t\\n\\x0B\\f\\r"), q.NO_UPPER
    ctes = [
        "w AS MATERIALIZED (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents)",
        "g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) u(i))",
        "c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id)",
        f"s AS (SELECT doc_id, {name('lang')} AS a, {name('source')} AS b, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{q.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(w, lambda x: length(x) <= 2)) AS BIGINT) AS n_short, {count(signs)} AS n_signs, {count(upper)} AS n_upper FROM w LEFT JOIN c USING (doc_id))",
        f"q AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, sqrt(n_words / (n_words + {q.HALF})) AS weight, ln({chars} / {n}) AS x0, {root(f'n_signs / {chars}')} AS x1, {root(f'n_short / {n}')} AS x2, {root(f'n_upper / {chars}')} AS x3 FROM s)",
        "k AS (SELECT a, b, count(*) AS n FROM q WHERE NOT base_failed GROUP BY a, b)",
        f"grp AS (SELECT a, b, CASE WHEN n >= {q.MIN_GROUP} THEN a || chr(31) || b WHEN pooled >= {q.MIN_GROUP} THEN a ELSE chr(31) END AS g FROM (SELECT *, sum(CASE WHEN n >= {q.MIN_GROUP} THEN 0 ELSE n END) OVER (PARTITION BY a) AS pooled FROM k))",
        f"x AS MATERIALIZED (SELECT g, weight, {of(lambda i: f'x{i}')} FROM q JOIN grp USING (a, b) WHERE NOT base_failed)",
    ]
    cells = " UNION ALL ".join(f"SELECT g, {i} AS i, CAST(floor(x{i} / {q.WIDTH!r}) AS BIGINT) AS c FROM x" for i in range(p))
    ctes += [
        f"hc AS (SELECT g, i, c, count(*) AS n FROM ({cells}) GROUP BY ALL)",
        "hr AS (SELECT g, i, c, sum(n) OVER (PARTITION BY g, i ORDER BY c) / sum(n) OVER (PARTITION BY g, i) AS r FROM hc)",
        "hm AS (SELECT g, i, min(c) FILTER (WHERE r >= 0.25) AS lo, min(c) FILTER (WHERE r >= 0.5) AS mid, min(c) FILTER (WHERE r >= 0.75) AS hi FROM hr GROUP BY g, i)",
        f"h AS (SELECT g, {of(lambda i: f'max((mid + 0.5) * {q.WIDTH!r}) FILTER (WHERE i = {i}) AS c{i}, max(greatest((hi - lo) * {q.WIDTH!r} / 1.349, {q.TINY!r})) FILTER (WHERE i = {i}) AS r{i}')} FROM hm GROUP BY g)",
        f"z AS MATERIALIZED (SELECT g, {of(lambda i: f'(x{i} - c{i}) * weight AS z{i}, r{i}')} FROM x JOIN h USING (g))",
    ]
    factor = [*[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in low]]

    def distance(x: str) -> str:
        """``x`` with d2, by nested subselects."""
        for i in range(p):
            known = "".join(f" - l{i}{j} * y{j}" for j in range(i))
            x = f"(SELECT *, (z{i} - m{i}{known}) / l{i}{i} AS y{i} FROM {x})"
        return f"(SELECT *, {of(lambda i: f'y{i} * y{i}', ' + ')} AS d2 FROM {x})"

    cell = f"CAST(floor(greatest(-{q.GRID}.0, least({q.GRID}.0, ln(d2 + 1e-12))) * {q.CELLS}) AS BIGINT)"
    moments = lambda x: ", ".join(["count(*) AS n", *[f"sum({x(i)}) AS s{i}" for i in range(p)], *[f"sum({x(i)} * {x(j)}) AS s{i}_{j}" for i, j in q.PAIRS]])

    def factors(x: str, centre: bool = True) -> str:
        x = f"(SELECT *, {of(lambda i: f's{i} / n AS m{i}')} FROM {x})"
        for i, j in low:
            rest = f"(s{j}_{i} / n - m{i} * m{j})" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            x = f"(SELECT *, {f'CASE WHEN {rest} > {q.TINY**2!r} THEN sqrt(greatest({rest}, 0)) ELSE {q.OUT!r} END' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM {x})"
        det = of(lambda i: f"CASE WHEN l{i}{i} < {q.OUT!r} THEN ln(l{i}{i}) ELSE 0 END", " + ")
        return f"(SELECT g, v, {', '.join(c if centre or c[0] == 'l' else f'0.0::DOUBLE AS {c}' for c in factor)}, {det} AS det FROM {x})"

    held = lambda i: f"(greatest(-{q.WINSOR}, least({q.WINSOR}, z{i} / r{i})) * r{i})"
    plain = ", ".join([f"0.0::DOUBLE AS m{i}" for i in range(p)] + [f"r{i} AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in low])
    ctes.append(f"e0 AS MATERIALIZED (SELECT g, 0 AS v, {plain}, 0.0::DOUBLE AS det FROM h UNION ALL SELECT * FROM {factors(f'(SELECT g, 1 AS v, {moments(held)} FROM z GROUP BY g)', False)})")
    for step in range(q.STEPS):
        ctes += [
            f"c{step} AS (SELECT g, v, {cell} AS c, {moments(lambda i: f'z{i}')} FROM {distance(f'(SELECT * FROM z JOIN e{step} USING (g))')} GROUP BY ALL)",
            f"t{step} AS (SELECT g, v, c, sum(n) OVER (PARTITION BY g, v) AS every, {', '.join(f'sum({k}) OVER (PARTITION BY g, v ORDER BY c) AS {k}' for k in q.SUMS)} FROM c{step})",
            f"f{step} AS (SELECT g, v, max(every) AS every, {', '.join(f'min_by({k}, c) AS {k}' for k in q.SUMS)} FROM t{step} WHERE n >= every * {q.H_SHARE} GROUP BY g, v)",
            f"n{step} AS MATERIALIZED (SELECT * FROM {factors(f'(SELECT * FROM f{step} WHERE every >= {q.MIN_GROUP})')})",
            # once settled, a step passes on what it was given
            f"e{step + 1} AS MATERIALIZED (SELECT * FROM n{step} WHERE {f'NOT (SELECT done FROM d{step - 1})' if step else 'true'}" + (f" UNION ALL SELECT * FROM e{step} WHERE (SELECT done FROM d{step - 1})" if step else "") + ")",
            f"d{step} AS MATERIALIZED (SELECT " + (f"(SELECT done FROM d{step - 1}) OR (SELECT sum(det) FROM e{step}) - (SELECT sum(det) FROM e{step + 1}) < {q.TOLERANCE} * (SELECT count(*) FROM e{step + 1})" if step else "false") + " AS done)",
        ]
    ctes += [
        f"best AS MATERIALIZED (SELECT g, {', '.join(f'arg_min({c}, det * 4 + v * 1e-12) AS {c}' for c in factor)} FROM e{q.STEPS} GROUP BY g)",
        f"dc AS (SELECT g, {cell} AS c, count(*) AS n FROM {distance('(SELECT * FROM z JOIN best USING (g))')} GROUP BY ALL)",
        f"sc AS (SELECT g, min(c) AS c FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY c) * 2 >= sum(n) OVER (PARTITION BY g) AS half FROM dc) WHERE half GROUP BY g)",
    ]
    freedom = of(lambda i: f"CASE WHEN l{i}{i} < {q.OUT!r} THEN 1 ELSE 0 END", " + ")
    pick = lambda values: f"[{', '.join(map(str, values))}][1 + {freedom}]"
    scaled = f"exp((c + 0.5) / {q.CELLS}) / {pick(q.MEDIANS)} AS scale, {pick(q.CUTS)} AS cut"
    source = distance(f"(SELECT *, {scaled}, {of(lambda i: f'(x{i} - c{i}) * weight AS z{i}')} FROM q LEFT JOIN grp USING (a, b) LEFT JOIN best USING (g) LEFT JOIN h USING (g) LEFT JOIN sc USING (g))")
    return f"""WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_short, n_signs, n_upper, NOT base_failed AND coalesce(d2 / scale <= cut, true) AS kept, round(d2 / scale, 3) AS distance2 FROM {source}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": DECONTAMINATE, "op3_chat_format": CHAT, "op4_mix_sources": MIX, "op7_quality_rules": quality_sql(), "op8_unit_dedup": UNITS, "op10_line_dedup": LINES}
