"""SQL (DuckDB) for the queries that SQL can express, by brute force."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_REACH = """
    reach(node, seen) AS (
        SELECT {id}, {id} FROM {nodes}
        UNION
        SELECT l.b, r.seen FROM reach r JOIN both_ways l ON l.a = r.node
    ),
    component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

OP1 = f"""
WITH RECURSIVE
    w AS (
        SELECT doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w
        FROM documents
    ),
    s AS (
        SELECT doc_id, CASE WHEN len(w) < 2 THEN w
            ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s
        FROM w
    ),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
        FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
        GROUP BY ALL
    ),
    links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    {_REACH.format(id="doc_id", nodes="documents")}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN component c ON c.node = s.doc_id
"""

OP4 = f"""
WITH RECURSIVE
    v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
          AND len([x for x in embedding if x <> 0]) > 0
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    {_REACH.format(id="vec_id", nodes="embeddings")}
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) n ON n.a = e.vec_id
"""

# A round goes through those that are not larger than the gap, in hash order, up to the first that does not fit.
OP7_ROUNDS = ",".join(
    f"""
    u{r} AS (
        SELECT *, sum(CASE WHEN NOT chosen AND size <= gap THEN part ELSE 0 END) OVER (PARTITION BY source ORDER BY h, size) AS upto
        FROM f{r - 1}
    ),
    c{r} AS (SELECT *, NOT chosen AND gap > 0 AND size <= gap AND upto <= gap AS now FROM u{r}),
    f{r} AS (
        SELECT source, h, size, part, chosen OR now AS chosen,
            (gap - sum(CASE WHEN now THEN part ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS gap
        FROM c{r}
    )"""
    for r in range(1, 5)
)

OP7 = f"""
WITH
    d AS (
        SELECT doc_id, source, coalesce(len({WORDS.format('text')}), 0)::BIGINT AS size,
            md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS h,
            row_number() OVER (PARTITION BY source, doc_id, size) AS n
        FROM documents
    ),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (
        SELECT *, 2 * source_size::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total,
            ([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3])::DOUBLE AS weight
        FROM s
    ),
    l AS (
        SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rn,
            (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
        FROM w
    ),
    t AS (
        SELECT source, source_size,
            coalesce(least(cap, (SELECT lv FROM l WHERE lv * weight < cap ORDER BY rn LIMIT 1) * weight), cap) AS target
        FROM l
    ),
    e AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
    ),
    f0 AS (
        SELECT d.source, d.h, d.size, sum(d.size)::BIGINT AS part, false AS chosen,
            any_value(round(e.target - e.whole * e.source_size))::BIGINT AS gap
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source GROUP BY d.source, d.h, d.size
    ),
    {OP7_ROUNDS},
    k AS (
        SELECT source, h, size, gap, least(part // size, greatest(1, (2 * gap + size) // (2 * size))) AS k
        FROM f4 WHERE NOT chosen AND 0 < size AND size < 2 * gap
    ),
    n AS (
        SELECT source, arg_min({{'h': h, 'size': size, 'k': k}}, (abs(k * size - gap), h, size)) AS best
        FROM k WHERE abs(k * size - gap) < gap GROUP BY source
    )
SELECT d.doc_id, d.size, e.source_size, e.target,
    ((e.whole + CASE WHEN f4.chosen OR (n.best.h = d.h AND n.best.size = d.size AND d.n <= n.best.k) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
    JOIN f4 ON d.source IS NOT DISTINCT FROM f4.source AND d.h = f4.h AND d.size = f4.size
    LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source
"""

OP11 = r"""
WITH
    l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
        FROM documents
    ),
    k AS (
        SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ),
    r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.holder AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH
    d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents),
    n AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
    c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
    q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
    p AS (
        SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM n)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL
    ),
    w AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c
    ),
    s AS (
        SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL
    )
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))))"""

OP13 = f"""
WITH
    g AS (
        SELECT doc_id, coalesce({WORDS.format('text')}, []) AS w, {_CRC32} AS h FROM documents
    ),
    m AS (
        SELECT doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
            3 + (h // 10) % 8 AS d
        FROM g
    ),
    d AS (
        SELECT doc_id, n, CASE WHEN planted THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END] for i in range(n)]
            ELSE w END AS w
        FROM m
    ),
    x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
    equal AS (
        SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i
        WHERE 4 * (b.i - a.i) <= a.n
    ),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
    stretches AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
        HAVING count(*) + q >= greatest(6, 4 * q)
    ),
    runs AS (
        SELECT * FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches t
            WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
    ),
    found AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS shown FROM runs GROUP BY doc_id
    ),
    best AS (
        SELECT * FROM runs r WHERE NOT EXISTS (
            SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.q > r.length * o.q
                OR o.length * r.q = r.length * o.q AND (o.start, o.q) < (r.start, r.q)))
    ),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
    kept AS (
        SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS rest FROM x ANTI JOIN dropped USING (doc_id, i) GROUP BY x.doc_id
    )
SELECT d.doc_id, coalesce(f.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
    ((1000 * b.length) // b.q)::BIGINT AS exponent_milli, sha256(coalesce(f.shown, '')) AS runs_sha256, sha256(coalesce(k.rest, '')) AS collapsed_sha256
FROM d LEFT JOIN found f ON f.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op4_embedding_forest": OP4, "op7_source_mixing": OP7, "op11_line_dedup": OP11, "op12_lexical_search": OP12, "op13_periodic_runs": OP13}
