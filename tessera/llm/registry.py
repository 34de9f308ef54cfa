"""Named queries of this folder and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from tessera.llm import centroids, repair
from tessera.llm.chat import op4_chat
from tessera.llm.fingerprint import op5_fingerprint
from tessera.llm.html_extract import op2_html
from tessera.llm.language import op3_language, op3_pages, op3_priors
from tessera.llm.media import op6_interleaved, op6_media, op6_pages
from tessera.llm.mixing import op8_mixing
from tessera.llm.neighbours import op12_neighbours
from tessera.llm.packing import op1_packing
from tessera.llm.quality import op7_quality
from tessera.llm.sharding import LIMIT, op9_sharding
from tessera.llm.simhash import op10_simhash

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_html, op3_language, op3_pages, op3_priors, op4_chat, op5_fingerprint, op6_media, op6_interleaved, op6_pages, op7_quality, op8_mixing, op9_sharding, op10_simhash, repair.op11_repair, op12_neighbours, centroids.op13_centroids)
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op6_interleaved": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
        ), p AS (
          SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, i, i % 3 = 2 AS fig, line, line || repeat(' ', ((-strlen(line)) % 192 + 192) % 192) AS padded FROM l WHERE trim(line) <> ''
        ), stored AS (
          SELECT DISTINCT line, sha256(padded) AS digest, strlen(padded) AS n FROM p WHERE fig
        ), bytes AS (
          SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) r(n))
        ), hexed AS (
          SELECT line, digest, n, list_transform(range(strlen(line)), lambda k: ('0x' || substr(hex(encode(line)), 2 * k + 1, 2))::BIGINT) AS k FROM stored
        ), kept AS (
          SELECT digest, any_value(n) AS n FROM (SELECT *, xor(list_reduce(k, lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) % 10 AS r FROM hexed, bytes) WHERE r <> 0 GROUP BY 1
        )
        SELECT doc_id, position::INT AS position, CASE WHEN fig THEN 'media' ELSE 'text' END AS kind, CASE WHEN NOT fig THEN trim(regexp_replace(line, '\s+', ' ', 'g')) END AS text, CASE WHEN fig THEN sha256(padded) END AS digest,
               CASE WHEN fig THEN 'line ' || i END AS caption, n::BIGINT AS payload_bytes, CASE WHEN n IS NOT NULL THEN digest END AS payload_sha256
        FROM (SELECT p.*, k.n, k.digest FROM p LEFT JOIN kept k ON fig AND k.digest = sha256(padded))
    """,
    "op11_repair": repair.TWIN,
    "op13_centroids": centroids.TWIN,
    "op3_priors": r"""
        WITH langs AS (
          SELECT lang FROM documents WHERE lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 64
        ), h AS (
          SELECT lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
                 lower(regexp_extract(coalesce(html, ''), '(?i)<html[^>]*\slang\s*=\s*["'']?([a-z]{2})', 1)) AS declared
          FROM pages
        ), d AS (
          SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h
        ), each AS (
          SELECT d.*, lang, (declared = lang)::INT AS hit FROM d, langs
        ), world AS (
          SELECT lang, (sum(hit) + 1) / sum(sum(hit) + 1) OVER () AS p FROM each GROUP BY 1
        ), s AS (
          SELECT suffix, lang, (sum(hit) + 20 * any_value(w.p)) / (sum(sum(hit)) OVER (PARTITION BY suffix) + 20) AS p FROM each JOIN world w USING (lang) GROUP BY 1, 2
        ), m AS (
          SELECT domain, lang, (sum(hit) + 20 * any_value(s.p)) / (sum(sum(hit)) OVER (PARTITION BY domain) + 20) AS p FROM each JOIN s USING (suffix, lang) GROUP BY 1, 2
        )
        SELECT host, lang AS language, round((sum(hit) + 20 * any_value(m.p)) / (sum(sum(hit)) OVER (PARTITION BY host) + 20), 9) AS p
        FROM each JOIN m USING (domain, lang) GROUP BY 1, 2
    """,
    "op4_chat": r"""
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), laid AS (
          SELECT *, 17 + length(regexp_replace(role, '([\\<\[\n])', '\1\\', 'g')) + length(regexp_replace(text, '([\\<\[])', '\1\\', 'g')) AS n,
                 row_number() OVER o AS i, first_value(role) OVER o = 'system' AS has_system
          FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), counted AS (
          SELECT *, ceil(n / 4.0)::BIGINT AS tokens FROM laid
        ), summed AS (
          SELECT *, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 first_value(tokens) OVER o AS system_tokens, first_value(n) OVER o AS system_n,
                 lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(n, 1) OVER o AS n1, lag(n, 2) OVER o AS n2
          FROM counted WINDOW o AS (PARTITION BY conv_id ORDER BY i)
        ), strode AS (
          SELECT *, CASE WHEN has_system THEN system_tokens ELSE 0 END AS always, CASE WHEN has_system THEN 2 ELSE 1 END AS oldest,
                 floor((2048 - 512 - least(CASE WHEN has_system THEN system_tokens ELSE 0 END, 1534)) / 2.0) AS stride
          FROM summed
        ), cut AS (
          SELECT *, floor(before / stride) AS cell, tokens > stride AS long FROM strode
        ), opened AS (
          SELECT *, coalesce(lag(cell) OVER c <> cell OR long OR lag(long) OVER c, false) AND i > 1 AS opens,
                 CASE WHEN long THEN least(512, 2048 - always - tokens) ELSE 512 END AS room
          FROM cut WINDOW c AS (PARTITION BY conv_id ORDER BY i)
        ), repeated AS (
          SELECT *, opens AND has_system AS three, opens AND coalesce(i - 1 >= oldest AND t1 <= room, false) AS one,
                 opens AND coalesce(i - 1 >= oldest AND t1 <= room AND i - 2 >= oldest AND t1 + t2 <= room, false) AS two,
                 sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY i) AS w
          FROM opened
        ), laden AS (
          SELECT *, sum(tokens + CASE WHEN three THEN system_tokens ELSE 0 END + CASE WHEN one THEN t1 ELSE 0 END + CASE WHEN two THEN t2 ELSE 0 END)
                    OVER (PARTITION BY conv_id, w) > 2048 AS over
          FROM repeated
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n + CASE WHEN three THEN system_n ELSE 0 END + CASE WHEN one THEN n1 ELSE 0 END + CASE WHEN two THEN n2 ELSE 0 END)::BIGINT AS formatted_chars,
               count(DISTINCT w)::BIGINT AS n_windows, count(DISTINCT w) FILTER (over)::BIGINT AS n_over
        FROM laden GROUP BY conv_id
    """,
    "op9_sharding": f"""
        WITH k AS (
          SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
          FROM documents
        ), d AS (SELECT unnest(range(0, 21))::INT AS depth),
        sums AS (SELECT depth, key >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM k, d GROUP BY 1, 2),
        ranked AS (
          SELECT k.doc_id, s.depth, s.prefix, k.n_bytes, s.shard_bytes, s.shard_docs,
                 row_number() OVER (PARTITION BY k.doc_id ORDER BY s.depth) AS r
          FROM k JOIN sums s ON k.key >> (60 - s.depth) = s.prefix WHERE s.shard_bytes <= {LIMIT}
        )
        SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right('00000000000000000000' || bin(prefix), depth) END AS shard,
               depth, n_bytes, shard_bytes, shard_docs, false AS oversized
        FROM ranked WHERE r = 1
    """,
}
