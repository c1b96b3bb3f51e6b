"""The same results in DuckDB SQL, where SQL can express them."""

from reqguard.llm import imatch, license, mixing, preference, quality

#: Words of a text, as the contracts define them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def op7():
    stops = quoted(f"{v}{end}" for x in quality.STOP_WORDS for v in (x, x.capitalize()) for end in ("", ".", ",", ";", ":"))
    verdict = " AND ".join(["true"] + [f"{r.numerator} >= {r.low!r}::DOUBLE * {r.denominator}" for r in quality.RULES if r.low is not None]
                           + [f"{r.numerator} <= {r.high!r}::DOUBLE * {r.denominator}" for r in quality.RULES if r.high is not None])
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
    again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, sum(least(8, coalesce(after - i, 8))) AS n
                FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM again) GROUP BY r),
    lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS u
              FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_lines,
                 coalesce(lines.n - lines.u, 0) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                 len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, 1 AS one
          FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {verdict} AS kept FROM f"""


def lower_words(text):
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def op2():
    rows = ", ".join(f"({quoted([k])}, {quoted([v])})" for k, v in license.TEMPLATES.items())
    n = license.SHINGLE
    return f"""
    WITH t AS (SELECT license, {lower_words("v")} AS w FROM (VALUES {rows}) AS x(license, v)),
    own AS (SELECT DISTINCT license, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS u(i)),
    sizes AS (SELECT license, count(*) AS n_template FROM own GROUP BY license),
    d AS (SELECT row_number() OVER () AS r, doc_id, {lower_words("text")} AS w FROM documents),
    have AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS s
             FROM d, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
    hits AS (SELECT r, doc_id, license, count(*) AS n_found FROM have JOIN own USING (s) GROUP BY r, doc_id, license)
    SELECT doc_id, license, n_found, n_template, n_found / n_template AS containment FROM hits JOIN sizes USING (license)
    WHERE n_found >= {license.CONTAINED}::DOUBLE * n_template"""


def op5():
    open_, close = quoted([preference.OPEN]), "'<|im_end|>' || chr(10)"
    turn = lambda x: f"{open_} || {x}.role || chr(10) || {x}.text || {close}"
    shown = lambda ts: f"array_to_string(list_transform({ts}, lambda x: {turn('x')}), '')"
    # a turn's end is the length of all rendered up to it
    end = lambda ts: f"length({shown(f'{ts}[1:i]')})"
    spans = lambda ts: (f"array_to_string(list_transform(list_filter(range(1, len({ts}) + 1), lambda i: {ts}[i].role = 'assistant'), "  # noqa: E731
                        f"lambda i: ({end(ts)} - length({ts}[i].text || {close}))::VARCHAR || ':' || {end(ts)}::VARCHAR), ' ')")
    return f"""
    WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS t
               FROM conversations GROUP BY conv_id),
    l AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS pos FROM c),
    n AS (SELECT *, coalesce(lead({{'v': t[pos]}}) OVER w, first_value({{'v': t[pos]}}) OVER w).v AS other FROM l
          WINDOW w AS (ORDER BY conv_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    p AS (SELECT conv_id, t AS a, list_transform(t, lambda x, i: CASE WHEN i = pos AND other IS NOT NULL THEN other ELSE x END) AS b FROM n),
    q AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) - 1, len(a))::INT AS k FROM p),
    s AS (SELECT conv_id, k, a[1:k] AS p, a[k + 1:] AS a, b[k + 1:] AS b FROM q)
    SELECT conv_id, k AS prompt_turns, {shown('p')} AS prompt, {shown('a')} AS chosen, {shown('b')} AS rejected,
           {spans('a')} AS chosen_mask, {spans('b')} AS rejected_mask FROM s"""


def op6():
    w = ", ".join(f"{float(x)}::DOUBLE" for x in mixing.WEIGHTS)
    cap, share = mixing.CAP, f"{mixing.SHARE}::DOUBLE"
    return f"""
    WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    v AS (SELECT *, ([{w}])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM s),
    f AS (SELECT *, {cap} * source_size / weight AS filled FROM v),
    l AS (SELECT *, ({share} * (sum(source_size) OVER ())::BIGINT - {cap} * coalesce((sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
                 / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM f WINDOW o AS (ORDER BY filled, source ASC NULLS LAST)),
    g AS (SELECT source, source_size, least(weight * (SELECT level FROM l WHERE filled >= level ORDER BY filled, source ASC NULLS LAST LIMIT 1),
                                            ({cap} * source_size)::DOUBLE) AS target FROM l),
    p AS (SELECT doc_id, size, source_size, target, coalesce((sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
                + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END::BIGINT AS taken FROM p"""


def op9():
    lo, hi = imatch.BAND
    subsets = lambda t: (f"list_transform(range(0, {imatch.SUBSETS}), lambda k: CASE WHEN len(list_filter({t}, lambda x: x.s = k)) = 0 "  # noqa: E731
                         f"THEN '{imatch.NOTHING}' ELSE substr(md5(array_to_string(list_transform(list_filter({t}, lambda x: x.s = k), lambda x: x.t), ' ')), 1, 8) END)")
    every = lambda t, a: (f"CASE WHEN len({t}) > 0 THEN {subsets(t)} ELSE list_transform(range(0, {imatch.SUBSETS}), "  # noqa: E731
                          f"lambda k: substr(md5(k || ' ' || {a}), 1, 8)) END")
    def likeness(a, b):
        z = f"list_filter(list_zip({a}, {b}), lambda x: x[1] <> '{imatch.NOTHING}' OR x[2] <> '{imatch.NOTHING}')"
        return f"len(list_filter({z}, lambda x: x[1] = x[2])) / len({z})"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nx, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid
          FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(nx, 1, n_chars // 2) AS edited FROM n),
    own AS (SELECT doc_id, unnest(list_distinct({lower_words("text")})) AS t FROM d),
    lex AS (SELECT t FROM own GROUP BY t HAVING count(*) >= {lo}::DOUBLE * (SELECT count(*) FROM d) AND count(*) <= {hi}::DOUBLE * (SELECT count(*) FROM d)),
    terms AS (SELECT doc_id, false AS edited, t FROM own UNION ALL SELECT doc_id, true, unnest(list_distinct({lower_words("edited")})) FROM e),
    f AS (SELECT doc_id, edited, list({{'s': ('0x' || substr(md5(t), 1, 4))::INT % {imatch.SUBSETS}, 't': t}} ORDER BY t) AS ts
          FROM terms JOIN lex USING (t) GROUP BY doc_id, edited),
    w AS (SELECT doc_id, edited, string_agg(t, ' ' ORDER BY t) AS a FROM terms GROUP BY doc_id, edited),
    x AS (SELECT e.doc_id, e.n_chars, e.nid, sha256(e.edited) AS edited_sha256, coalesce(a.ts, []) AS ta, coalesce(b.ts, []) AS tb,
                 coalesce(c.a, '') AS wa, coalesce(d.a, '') AS wb
          FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND NOT a.edited LEFT JOIN f b ON b.doc_id = e.doc_id AND b.edited
          LEFT JOIN w c ON c.doc_id = e.doc_id AND NOT c.edited LEFT JOIN w d ON d.doc_id = e.doc_id AND d.edited),
    g AS (SELECT *, {every('ta', 'wa')} AS fa, {every('tb', 'wb')} AS fb FROM x)
    SELECT g.doc_id, g.n_chars, g.edited_sha256, array_to_string(g.fa, '') AS fingerprint, array_to_string(g.fb, '') AS edited_fingerprint,
           {likeness('g.fa', 'g.fb')} AS near_edited, {likeness('g.fa', 'h.fa')} AS near_next FROM g JOIN g AS h ON h.doc_id = g.nid"""


def op12():
    return """
    WITH r AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.n AS an, a.vec_id AS anchor_id, a.label = r.label AS alike, r.n, r.vec_id,
                 list_inner_product(a.v, r.v)::BIGINT AS score
          FROM r AS a JOIN r ON r.n <> a.n WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id ASC NULLS LAST, n) AS place FROM s WHERE alike),
    q AS (SELECT p.an, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.an, p.place ORDER BY s.score DESC, s.vec_id ASC NULLS LAST, s.n)::INTEGER AS rank
          FROM p JOIN s ON s.an = p.an AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
          WHERE p.place <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 3"""


def oracle_sql():
    return {"op2_license_scan": op2(), "op5_preferences": op5(), "op6_mixing": op6(), "op7_quality": op7(), "op9_imatch": op9(), "op12_hard_negatives": op12()}
