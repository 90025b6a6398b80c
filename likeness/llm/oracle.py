"""SQL counterparts of the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"

#: least id reachable from every node over ``links`` (a, b), which hold both directions
_REACH = """
reach AS (
    SELECT a, a AS r FROM (SELECT DISTINCT a FROM links)
    UNION
    SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.a
)"""

ORACLE: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
    SELECT k, doc_id, h, len(h) // 2 AS n FROM docs
), pieces AS (
    SELECT k, n, lo, substr(h, 2 * lo + 1, 2 * 711) AS piece
    FROM (SELECT k, h, n, unnest(range(0, n - 199, 512)) AS lo FROM sized WHERE n >= 200)
), strings AS (
    SELECT k, lo + j AS i, md5(substr(piece, 2 * j + 1, 400)) AS s
    FROM (SELECT k, lo, piece, unnest(range(0, least(512, n - 199 - lo))) AS j FROM pieces)
), again AS (
    SELECT k, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)
), marked AS (
    SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again
), runs AS (
    SELECT k, run, min(i) AS lo, max(i) + 200 AS hi
    FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM marked) GROUP BY k, run
), gaps AS (
    SELECT k, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY k ORDER BY lo) AS since FROM runs
), cut AS (
    SELECT k, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS upto,
           string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head
    FROM gaps JOIN sized USING (k) GROUP BY k
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM sized LEFT JOIN cut USING (k)""",

    "op3_benchmark_decontamination": f"""
WITH items AS (
    SELECT item_id, {_TERMS.format('text')} AS w FROM benchmark
), windows AS (
    SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS gram FROM items WHERE len(w) BETWEEN 1 AND 9
    UNION
    SELECT item_id, 10, array_to_string(w[i:i + 9], ' ')
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10)
), docs AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce({_TERMS.format('text')}, []) AS w FROM documents
), grams AS (
    SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
    SELECT k, i, n, item_id FROM grams JOIN windows USING (n, gram)
), hits AS (
    SELECT k, count(DISTINCT pos) AS n_hit
    FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT k, i, n FROM found)) GROUP BY k
), named AS (
    SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM found) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN named USING (k)""",

    "op7_source_mixing": r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(text, '')) AS h,
           (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sources
), ordered AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0) AS spent, sum(weight) OVER rest AS weights, sum(source_size) OVER () AS total
    FROM weighed
    WINDOW rest AS (ORDER BY weight / nullif(source_size, 0) DESC NULLS FIRST, coalesce('v' || source, 'n') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           before AS (ORDER BY weight / nullif(source_size, 0) DESC NULLS FIRST, coalesce('v' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tried AS (
    SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * spent::DOUBLE) / weights AS level FROM ordered
), capped AS (
    SELECT *, weight * level > 2.0::DOUBLE * source_size AS limited FROM tried
), plan AS (
    SELECT source, source_size, CASE WHEN limited OR source_size = 0 THEN 2.0::DOUBLE * source_size
           ELSE least(weight * (SELECT arg_max(level, weight / source_size) FROM capped WHERE NOT limited AND source_size > 0), 2.0::DOUBLE * source_size) END AS target
    FROM capped
), shares AS (
    SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM plan
), drawn AS (
    SELECT *, round(target)::BIGINT - whole * source_size AS sample, target / nullif(source_size, 0) - whole AS chance FROM shares
), odds AS (
    SELECT d.doc_id, d.size, d.h, p.*, (u * (1 - chance)) / nullif((1 - u) * chance, 0) AS odds
    FROM docs d JOIN drawn p ON d.source IS NOT DISTINCT FROM p.source
), runs AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY coalesce(odds / (1 + odds), 1.0), h ROWS UNBOUNDED PRECEDING) - size AS before FROM odds
)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, sample - before)))::BIGINT AS taken FROM runs""",

    "op8_minhash_near_dedup": f"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce({_TOKENS.format('text')}, []) AS w FROM documents
), shingles AS (
    SELECT k, array_to_string(w, ' ') AS s FROM words WHERE len(w) BETWEEN 1 AND 2
    UNION
    SELECT k, array_to_string(w[i:i + 2], ' ') FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), sets AS (
    SELECT k, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS node FROM shingles GROUP BY k
), nodes AS (
    SELECT node, any_value(n) AS n, min(k) AS k FROM sets GROUP BY node
), parts AS (
    SELECT node, n, s FROM nodes JOIN shingles USING (k)
), both_ AS (
    SELECT p.node AS a, q.node AS b, p.n AS x, q.n AS y, count(*) AS same
    FROM parts p JOIN parts q ON p.s = q.s AND p.node <> q.node AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
    GROUP BY ALL
), links AS (
    SELECT a, b FROM both_ WHERE 100 * same >= 85 * (x + y - same)
), {_REACH}, ids AS (
    SELECT node, min(doc_id) AS id FROM sets JOIN words USING (k) GROUP BY node
), classes AS (
    SELECT a AS node, min(id) AS least FROM reach JOIN ids ON r = node GROUP BY a
), named AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c.least, i.id, doc_id) AS component_id
    FROM words LEFT JOIN sets USING (k) LEFT JOIN ids i ON i.node = sets.node LEFT JOIN classes c ON c.node = sets.node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named""",

    "op9_embedding_near_dedup": f"""
WITH RECURSIVE given AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT vec_id, v FROM given
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.95
), {_REACH}, classes AS (
    SELECT a AS vec_id, min(r) AS least FROM reach GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM given LEFT JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)""",

    # Conversations step through the grammar (0 start, 1 system, 2 user, 3 assistant) turn by turn; before each
    # turn at most one insertion can pay, at the end at most two.
    "op11_conversation_repair": r"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key FROM conversations
), bits AS (
    SELECT *, list_transform(range(0, octet_length(key) * 8), lambda i:
        ((('0x' || substr(hex(key), 2 * (i // 8) + 1, 2))::INTEGER >> (i % 8)::INTEGER) & 1)::BIGINT) AS b FROM coded
), hashed AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
        xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % 20 AS fault FROM bits
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE fault > 0
), ordered AS (
    SELECT conv_id, turn, role, text, row_number() OVER w AS i, substr(role, 1, 1) AS first,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
           substr(lag(role) OVER w, 1, 1) AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy)
), faulty AS MATERIALIZED (
    SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS again,
           body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
           before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au') AS bad FROM ordered
), counted AS MATERIALIZED (
    SELECT conv_id, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again, count(*) FILTER (cut) AS cut, count(*) FILTER (bad) AS bad
    FROM faulty GROUP BY conv_id
), grammar (state, need, word, nxt) AS (VALUES (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)
), moves (state, first, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM counted
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
        SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
            SELECT f.conv_id, f.i, e.state, o.cost + e.cost AS cost, o.audit || e.letter AS audit,
                   o.said || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.word || ':' || f.text] END AS said
            FROM (
                SELECT conv_id, i, state, cost, audit, said FROM walk
                UNION ALL
                SELECT conv_id, i, nxt, cost + 2, audit || 'I', said || [word || ':'] FROM walk JOIN grammar USING (state)
            ) o JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1
            JOIN (
                SELECT g.state AS since, 'D' AS letter, g.state, 3 AS cost, NULL AS first, '' AS word FROM grammar g
                UNION ALL SELECT g.state, 'R', g.nxt, 2, NULL, g.word FROM grammar g
                UNION ALL SELECT m.state, 'K', m.nxt, 0, m.first, '' FROM moves m
            ) p ON p.since = o.state AND (p.letter = 'D' OR NOT (f.blank OR f.again)) AND (p.first IS NULL OR p.first = f.first)
            CROSS JOIN LATERAL (SELECT p.letter AS letter, p.state AS state, p.word AS word,
                                       p.cost + CASE WHEN p.letter <> 'D' AND f.cut THEN 1 ELSE 0 END AS cost) e
        ) GROUP BY conv_id, i, state
    )
), ends AS (
    SELECT conv_id, min({'cost': cost + extra, 'audit': audit || tail, 'said': said || more}) AS best
    FROM walk JOIN counted c USING (conv_id)
    JOIN (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []::VARCHAR[]), (2, 2, 'I', ['assistant:']),
                 (1, 4, 'II', ['user:', 'assistant:'])) t(state, extra, tail, more) USING (state)
    WHERE walk.i = c.turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(again, 0)::BIGINT AS duplicate,
       coalesce(cut, 0)::BIGINT AS truncated, coalesce(bad, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN ends USING (conv_id)""",

    "op13_phrase_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(""" + _LOWER.format("text") + r""", '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), cut AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, 1 AS m, unnest(w) AS p FROM cut
    UNION ALL
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ')
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM cut, (VALUES (2), (3)) t(m) WHERE len(w) >= m)
), f AS MATERIALIZED (
    SELECT lang, m, p, count(*) AS f FROM grams GROUP BY lang, m, p
), total AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), kept AS MATERIALIZED (
    SELECT * FROM f c WHERE m = 3 AND f >= 10
    UNION ALL
    SELECT c.* FROM f c LEFT JOIN (
        SELECT lang, p, max(f) AS most FROM (
            SELECT lang, array_to_string(string_split(p, ' ')[i:i + 1], ' ') AS p, f
            FROM f, (VALUES (1), (2)) t(i) WHERE m = 3 AND f >= 10) GROUP BY lang, p
    ) l USING (lang, p) WHERE c.m = 2 AND c.f >= 10 AND (most IS NULL OR 100 * most < 50 * c.f)
), parts AS MATERIALIZED (
    SELECT lang, p, f AS a, k, array_to_string(string_split(p, ' ')[:k], ' ') AS lp, array_to_string(string_split(p, ' ')[k + 1:], ' ') AS rp
    FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), lefts AS MATERIALIZED (
    SELECT c.*, f.f AS l FROM parts c JOIN f ON f.lang = c.lang AND f.p = lp
), scored AS (
    SELECT c.lang, c.p, a, k, l, f.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * f.f) AS s
    FROM lefts c JOIN f ON f.lang = c.lang AND f.p = rp
), least AS (
    SELECT lang, p, a, l, r, s FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY s, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, encode(p)) AS rank FROM least
)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, s::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
