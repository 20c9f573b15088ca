"""DuckDB SQL for the queries that SQL can express."""

from allometra.llm.source_mix import golden

QUALITY_RULES = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM texts
), starts AS (
    SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 5
), counted AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i:i+4]) AS c FROM starts
), covered AS (
    SELECT row_id, count(DISTINCT i + k) AS n FROM counted, range(0, 5) AS r(k) WHERE c > 1 GROUP BY row_id
), measured AS (
    SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN covered USING (row_id)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 10 > n_words OR (n_dup_lines > 2 AND n_dup_lines * 10 > n_lines * 3)
        OR word_chars < n_words * 2 OR word_chars > n_words * 20
        OR length(regexp_replace(t, '\P{Lu}+', '', 'g')) * 2 > word_chars) AS kept
FROM judged
"""

SOURCE_MIX = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS k
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, 3 * source_size AS cap,
        [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted WINDOW b AS (ORDER BY cap / weight, source NULLS LAST)
), aimed AS (
    SELECT source, source_size,
        least(cap::DOUBLE, weight * coalesce(max(level) FILTER (cap / weight > level) OVER (), 0)) AS target
    FROM levels
), quotas AS (
    SELECT *, floor(target + 0.5)::BIGINT AS quota FROM aimed
), lines AS (
    SELECT *, row_number() OVER () AS row_id, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS begins FROM sized
), divided AS (
    SELECT *, (source_size + 2047) // 2048 AS blocks, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM quotas
), slotted AS (
    SELECT *, quota - passes * source_size AS rest, passes * blocks + (quota - passes * source_size + 2047) // 2048 AS slots FROM divided
), shares AS (
    SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / greatest(sum(slots) OVER (), 1) AS hi FROM slotted
), bounds AS (
    SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM shares
), points AS (
    SELECT i AS slot, (i // 1048576 * GOLDEN_20::DOUBLE + (i % 1048576 + 0.5)::DOUBLE * GOLDEN_0::DOUBLE) % 1.0::DOUBLE AS u
    FROM (SELECT unnest(range(sum(slots)::BIGINT)) AS i FROM slotted)
), drawn AS (
    SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN bounds ON lo <= u AND u < hi
), had AS (
    SELECT b.source, slots, count(d.slot) AS n FROM bounds AS b LEFT JOIN drawn AS d ON b.source IS NOT DISTINCT FROM d.source GROUP BY ALL
), owed AS (
    SELECT source, unnest(range(n, slots::BIGINT)) AS rank FROM had
), ranked AS (
    SELECT slot, source, rank FROM drawn UNION ALL SELECT (SELECT sum(slots) FROM slotted) + rank, source, rank FROM owed
), schedule AS (
    SELECT r.slot, r.source, rank % blocks AS block, least((rank % blocks + 1) * 2048, CASE WHEN rank // blocks < passes THEN source_size ELSE rest END) AS ends
    FROM ranked AS r JOIN slotted AS s ON r.source IS NOT DISTINCT FROM s.source WHERE rank < slots
), starts AS (
    SELECT row_id, min(slot)::BIGINT AS first_slot FROM lines AS l JOIN schedule AS s ON l.source IS NOT DISTINCT FROM s.source AND block = begins // 2048
    WHERE size > 0 AND ends > begins GROUP BY row_id
)
SELECT doc_id, size, source_size, target,
    (CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size
        + greatest(0, least(size, quota % source_size - begins)) END)::BIGINT AS taken, first_slot
FROM lines JOIN quotas ON lines.source IS NOT DISTINCT FROM quotas.source LEFT JOIN starts USING (row_id)
"""
for _power in (20, 0):
    SOURCE_MIX = SOURCE_MIX.replace(f"GOLDEN_{_power}", repr(golden(_power)))

SOURCE_DIVERGENCE = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), terms AS (
    SELECT row_id, lang, source, unnest(w) AS term FROM texts
), kept AS (
    SELECT lang, term, count(*) AS total FROM terms GROUP BY ALL HAVING count(DISTINCT row_id) >= 3
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM texts
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang
), sizes AS (
    SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL
), rates AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(size, 0) + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + v)::HUGEINT AS q
    FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN sizes USING (lang, source)
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM rates AS a JOIN rates AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups AS g JOIN groups AS h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN sums AS s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), named AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM rates WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM named)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

COLLOCATIONS = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
    SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), runs AS (
    SELECT lang, size, w[i:i + size - 1] AS words FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, 6) AS s(size) WHERE len(w) >= size)
), counts AS (
    SELECT lang, size, words, array_to_string(words, ' ') AS phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) AS c
    JOIN counts AS l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN counts AS r ON r.lang = c.lang AND r.words = c.words[k + 1:]
    JOIN totals AS t ON t.lang = c.lang
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT DISTINCT c.lang, c.phrase FROM counts AS c JOIN counts AS o
    ON o.lang = c.lang AND o.size > c.size AND c.size > 1 AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM scored ANTI JOIN inside USING (lang, phrase)
) WHERE rank <= 2000
"""
