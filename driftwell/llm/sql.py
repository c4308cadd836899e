"""DuckDB SQL of the queries that SQL can say."""


def quality_rules(rounds: int = 30) -> str:
    """Counts, votes, and as many rounds of expectation-maximisation over vote patterns from four starts, each a pair of tables; then the likeliest."""
    votes = {
        "word_length": ("2 * word_chars < 5 * n_words OR word_chars > 7 * n_words", "word_chars BETWEEN 3 * n_words AND 6 * n_words"),
        "symbols": ("20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
        "letters": ("100 * n_letters < 90 * word_chars", "100 * n_letters >= 94 * word_chars"),
        "endings": ("10 * n_ended < 9 * n_lines", "n_ended = n_lines"),
        "lines": ("100 * n_dup_lines > 35 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
        "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
        "variety": ("100 * n_distinct < 45 * n_words", "100 * n_distinct >= 60 * n_words"),
        "lower": ("100 * n_lower < 70 * n_words", "100 * n_lower >= 84 * n_words"),
        "capitals": ("100 * n_capitals > 20 * word_chars", "100 * n_capitals <= 6 * word_chars"),
    }
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {k}" for k, (bad, good) in votes.items())
    on = lambda r, v, w: f"coalesce(sum(n * {w}) FILTER ({r} = {v}), 0)"
    sums = ", ".join(f"{on(r, 1, 's')} + 1 AS gp_{r}, {on(r, -1, 's')} + 0.5 AS gn_{r}, {on(r, 1, '(1 - s)')} + 0.5 AS bp_{r}, {on(r, -1, '(1 - s)')} + 1 AS bn_{r}" for r in votes)
    chance = lambda r: f"gp_{r} / (gp_{r} + gn_{r}) < bp_{r} / (bp_{r} + bn_{r})"
    pooled = lambda r: f"(gp_{r} + bp_{r}) / (gp_{r} + gn_{r} + bp_{r} + bn_{r})"
    rates = ", ".join(
        f"CASE WHEN {chance(r)} THEN {pooled(r)} ELSE gp_{r} / (gp_{r} + gn_{r}) END AS g_{r}, CASE WHEN {chance(r)} THEN 1 - {pooled(r)} ELSE bn_{r} / (bp_{r} + bn_{r}) END AS b_{r}" for r in votes
    )
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"CASE p.{r} WHEN 1 THEN ln(g_{r} / (1 - b_{r})) WHEN -1 THEN ln((1 - g_{r}) / b_{r}) ELSE 0 END" for r in votes)])
    bad = " + ".join(["ln(1 - prior)", *(f"CASE p.{r} WHEN 1 THEN ln(1 - b_{r}) WHEN -1 THEN ln(b_{r}) ELSE 0 END" for r in votes)])
    imagined = " + ".join(f"ln(g_{r} * b_{r}) + 0.5 * ln((1 - g_{r}) * (1 - b_{r}))" for r in votes)
    own, names = ", ".join(votes), ", ".join(f"p.{r}" for r in votes)
    count = lambda v: " + ".join(f"({r} = {v})::INT" for r in votes)
    steps = ", ".join(
        f"""q{k} AS MATERIALIZED (SELECT begun, (sum(n * s) + 1) / (sum(n) + 2) AS prior, {sums} FROM p{k} GROUP BY begun),
        m{k} AS MATERIALIZED (SELECT begun, prior, {rates} FROM q{k}),
        p{k + 1} AS MATERIALIZED (SELECT {names}, p.begun, p.n, 1 / (1 + exp(-({odds}))) AS s{f", n * ({bad} + ln(1 + exp({odds}))) AS l" if k + 1 == rounds else ""} FROM p{k} p JOIN m{k} m ON p.begun = m.begun)"""
        for k in range(rounds)
    )
    return rf"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents
        ), places AS (SELECT row_id, unnest(range(1, len(w) - 1)) AS i, w FROM texts WHERE len(w) >= 3),
        grams AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS often FROM places),
        covered AS (SELECT row_id, count(DISTINCT place) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM grams WHERE often > 1) GROUP BY 1),
        counted AS MATERIALIZED (
            SELECT texts.row_id, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                len(regexp_extract_all(t, '\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}'))) AS n_lower, len(list_distinct(w)) AS n_distinct,
                len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))) AS n_ended, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
            FROM texts LEFT JOIN covered ON texts.row_id = covered.row_id
        ), voted AS MATERIALIZED (SELECT *, {vote} FROM counted),
        patterns AS MATERIALIZED (SELECT {own}, CAST(count(*) AS DOUBLE) AS n, {count(-1)} AS against, {count(1)} AS pro FROM voted GROUP BY ALL),
        p0 AS MATERIALIZED (
            SELECT {own}, begun, n, CASE WHEN begun = 4 THEN (pro + 0.5) / (pro + against + 1) WHEN against >= begun THEN 0.1 ELSE 0.9 END AS s FROM patterns, (SELECT unnest([1, 2, 3, 4]) AS begun)
        ), {steps},
        best AS MATERIALIZED (SELECT begun FROM (SELECT p.begun, sum(l) + max(ln(prior * (1 - prior)) + {imagined}) AS l FROM p{rounds} p JOIN m{rounds - 1} m ON p.begun = m.begun GROUP BY 1) ORDER BY round(l / 1e-6) DESC, begun LIMIT 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND s >= 0.5 AS kept
        FROM voted JOIN p{rounds} p USING ({own}) JOIN best USING (begun)
    """


ORACLE_SQL = {
    "op2_quality_rules": quality_rules(),
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT row_id, doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
            FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), frequent AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_id) >= 10
        ), marked AS (
            SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY row_id, doc_id
    """,
    "op10_decontamination": r"""
        WITH texts AS (
            SELECT 'd' AS kind, row_number() OVER () AS row_id, doc_id AS id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
        ), worded AS (
            SELECT kind, row_id, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
        ), widths AS (
            SELECT DISTINCT least(5, len(w)) AS width FROM worded WHERE kind = 'b' AND len(w) > 0
        ), grams AS (
            SELECT DISTINCT kind, row_id, id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS gram
            FROM worded JOIN widths ON len(w) >= width AND (kind = 'd' OR width = least(5, len(w)))
        ), items AS (
            SELECT row_id, id, width, gram, count(*) OVER (PARTITION BY row_id) AS n_item FROM grams WHERE kind = 'b'
        )
        SELECT d.id AS doc_id, i.id AS item_id, count(*)::INT AS n_shared, min(i.n_item)::INT AS n_item, count(*) / min(i.n_item) AS containment
        FROM grams d JOIN items i ON d.gram = i.gram AND d.width = i.width
        WHERE d.kind = 'd' GROUP BY d.row_id, d.id, i.row_id, i.id HAVING count(*) >= ceil(0.8 * min(i.n_item) - 1e-9)
    """,
    "op8_fixity_audit": r"""
        WITH pages2 AS (
            SELECT page_id, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 200 AS kind,
                'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Type: text/html' || nl
                || 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl AS record
            FROM pages, (SELECT chr(13) || chr(10) AS nl)
        ), sizes AS (
            SELECT page_id, kind, strlen(record) AS first_bytes, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN strlen(left(record, length(record) - 9)) ELSE strlen(record) END AS second_bytes FROM pages2
        ), placed AS (
            SELECT *, coalesce(sum(first_bytes) OVER before, 0) AS first_offset, coalesce(sum(second_bytes) OVER before, 0) AS second_offset
            FROM sizes WINDOW before AS (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        )
        SELECT page_id, CASE WHEN kind = 0 THEN 'missing' ELSE 'changed' END AS kind, CAST(first_offset AS BIGINT) AS first_offset, CAST(first_bytes AS BIGINT) AS first_bytes,
            CASE WHEN kind > 0 THEN CAST(second_offset AS BIGINT) ELSE -1 END AS second_offset, coalesce(CAST(second_bytes AS BIGINT), -1) AS second_bytes
        FROM placed WHERE kind < 3
    """,
    "op12_suffix_dedup": r"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS MATERIALIZED (
            SELECT row_id, s, md5(substr(h, 2 * s + 1, 400)) AS string FROM (SELECT row_id, h, unnest(range(len(h) // 2 - 199)) AS s FROM texts)
        ), starts AS (
            SELECT row_id, s FROM strings WHERE string IN (SELECT string FROM strings GROUP BY string HAVING count(*) > 1)
        ), marked AS (
            SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY row_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM starts
        ), spans AS (
            SELECT row_id, min(s) AS a, max(s) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY row_id ORDER BY s) AS span FROM marked) GROUP BY row_id, span
        ), parts AS (
            SELECT row_id, a, b, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS before FROM spans
        ), cut AS (
            SELECT p.row_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM parts p JOIN texts t ON p.row_id = t.row_id GROUP BY p.row_id
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM texts t LEFT JOIN cut c ON t.row_id = c.row_id
    """,
    "op13_lexical_search": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL
        ), queries AS (
            SELECT item_id, row_number() OVER () AS item, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
            FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
        ), asked AS (SELECT item, item_id, unnest(terms) AS term FROM queries
        ), corpus AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM texts WHERE len(terms) > 0
        ), cells AS (
            SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM cells GROUP BY term), corpus
        ), scores AS (
            SELECT item, item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
            FROM asked JOIN cells USING (term) JOIN weights USING (term), corpus GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row_id) AS rank FROM scores WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
