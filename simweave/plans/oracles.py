"""The same queries in SQL for DuckDB, written from the definitions and not from the plans.

Every statement is one chain of common table expressions; a query takes the chain up to the
stage it needs. Parameters come from the presets.
"""

from __future__ import annotations

from simweave import config as K
from simweave.config import PRESETS, AnalysisConfig
from simweave.functions.text import GRAM_MODULUS, KEPT, SPACE, UNREADABLE, gram_multipliers

_DROP, _WS = f"[^{KEPT}{SPACE}]", f"[{SPACE}]+"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({x}, '{_DROP}', '', 'g')), '{_WS}', ' ', 'g'))"


def _hash60(x: str) -> str:
    return f"CAST(concat('0x', substr(md5({x}), 1, 15)) AS BIGINT)"


def _hash64(x: str, k: int) -> str:
    """The hash of a gram of ``k`` characters: two halves of 32 bits, weighted sums of its code points."""
    halves = ["(" + " + ".join(f"unicode(substring({x}, {j + 1}, 1))::BIGINT * {m}" for j, m in enumerate(ms)) + f") % {GRAM_MODULUS}" for ms in gram_multipliers(k)]
    return f"(({halves[0]} - 2147483648) * 4294967296 + {halves[1]})"


def _majority(bits: str) -> str:
    """64 bits from ``i, ones, n``, the last one being the sign."""
    return f"CAST(sum(CASE WHEN ones * 2 < n THEN 0 WHEN i = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << i END) AS BIGINT) AS simhash FROM {bits} GROUP BY ALL"


_PAGES = {
    "page_texts": """
        corpus AS (SELECT file_id AS file, page, coalesce(arg_max(struct_pack(t := text), extracted_at).t, '') AS text FROM page_texts GROUP BY ALL),
        files_in AS (SELECT DISTINCT id AS file FROM files WHERE id IS NOT NULL)""",
    "documents": f"""
        split AS (SELECT 'doc-' || doc_id AS file, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents),
        corpus AS (SELECT file, CAST(p + 1 AS INTEGER) AS page, array_to_string(ls[p * 8 + 1:p * 8 + 8], chr(10)) AS text
                   FROM (SELECT file, ls, unnest(range(0, CAST(ceil(len(ls) / 8.0) AS BIGINT))) AS p FROM split)),
        files_in AS (SELECT 'doc-' || doc_id AS file FROM documents)""",
    "evidence": """
        matches AS (SELECT DISTINCT match_id, pair_id, left_text, right_text FROM matched_texts),
        numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY match_id) AS INTEGER) AS page FROM matches),
        corpus AS (SELECT pair_id || '/left' AS file, page, coalesce(left_text, '') AS text FROM numbered
                   UNION ALL SELECT pair_id || '/right', page, coalesce(right_text, '') FROM numbered),
        files_in AS (SELECT DISTINCT file FROM corpus)""",
}
_PAGES["evidence+images"] = _PAGES["evidence"].replace("SELECT DISTINCT file FROM corpus)", "SELECT DISTINCT file FROM corpus UNION SELECT DISTINCT file FROM image)")

_IMAGES = """
    vec AS (SELECT vec_id AS v, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    med AS (SELECT v, e, list_sort(e[2:64])[32] AS m FROM vec),
    hashed AS (SELECT v, coalesce((SELECT bit_or(CAST(1 AS UBIGINT) << i) FROM (SELECT unnest(range(1, 64)) AS i) WHERE e[i + 1] >= m), 0) AS phash FROM med),
    flip AS (SELECT v, coalesce((SELECT bit_xor(CAST(1 AS UBIGINT) << CASE WHEN v % 2 = 0 THEN j + 1 ELSE 16 * (j % 4) + 1 + j // 4 END)
                                 FROM (SELECT unnest(range(0, 8)) AS j) WHERE j < v % 9), 0) AS mask FROM hashed),
    raw_image AS (
        SELECT v * 4 AS image, v % 40 AS f, CASE WHEN v % 2 = 0 THEN 400 ELSE 80 END AS width, CASE WHEN v % 2 = 0 THEN 300 ELSE 80 END AS height,
               sha256(CAST(v AS VARCHAR)) AS sha256, phash FROM hashed
        UNION ALL SELECT v * 4 + 1, (v + 7) % 40, CASE WHEN v % 2 = 0 THEN 400 ELSE 80 END, CASE WHEN v % 2 = 0 THEN 300 ELSE 80 END,
               sha256('n' || v), xor(phash, mask) FROM hashed JOIN flip USING (v) WHERE v % 5 = 0
        UNION ALL SELECT v * 4 + 2, (v + 13) % 40, CASE WHEN v % 2 = 0 THEN 400 ELSE 80 END, CASE WHEN v % 2 = 0 THEN 300 ELSE 80 END,
               sha256(CAST(v AS VARCHAR)), phash FROM hashed WHERE v % 7 = 0
        UNION ALL SELECT i * 4 + 3, i, 80, 80, sha256('logo'), CAST(4660 AS UBIGINT) FROM (SELECT unnest(range(0, 20)) AS i)),
    image AS (SELECT 'pair-' || f AS file, image, 1 AS page, width, height, sha256, phash FROM raw_image WHERE width >= 48 AND height >= 48 AND width * height >= 4096)
"""


def _image_stage(n: str, c: AnalysisConfig) -> str:
    cap = f"(CASE WHEN {n} >= 4 THEN least(({n} + 1) // 2, {K.MAX_FEATURE_FILES}) ELSE least({n}, {K.MAX_FEATURE_FILES}) END)"
    common = f"({n} >= 4 AND max(width * height) < {K.LARGE_IMAGE_AREA} AND count(DISTINCT file) > {cap})"
    return f"""
    common AS (SELECT sha256 FROM image GROUP BY sha256 HAVING {common}),
    exact_kept AS (SELECT sha256 FROM image GROUP BY sha256 HAVING count(*) <= {K.MAX_IMAGE_POSTING} AND NOT {common}),
    exact_image AS (SELECT DISTINCT a.file AS lf, b.file AS rf, 1.0::DOUBLE AS score FROM image a JOIN image b USING (sha256) JOIN exact_kept USING (sha256) WHERE a.file < b.file),
    shown AS (SELECT * FROM image ANTI JOIN common USING (sha256)),
    band AS (SELECT file, phash, width, height, b, (phash >> (16 * b)) & 65535 AS bits FROM shown, (SELECT unnest(range(0, 4)) AS b)),
    band_kept AS (SELECT b, bits FROM band GROUP BY b, bits HAVING count(*) <= {K.MAX_IMAGE_POSTING} AND NOT {common}),
    band_image AS (SELECT x.file AS lf, y.file AS rf, max(1 - bit_count(xor(x.phash, y.phash)) / 64.0) AS score
                   FROM band x JOIN band y USING (b, bits) JOIN band_kept USING (b, bits)
                   WHERE x.file < y.file AND bit_count(xor(x.phash, y.phash)) <= {c.phash_distance} GROUP BY ALL),
    image_cand AS (SELECT lf, rf, max(score) AS score FROM (SELECT * FROM exact_image UNION ALL SELECT * FROM band_image) GROUP BY ALL)"""


def _match_stage(cand: str, c: AnalysisConfig) -> str:
    order = "exact DESC, d, w DESC, li, ri"
    return f"""
    met AS (SELECT c.lf, c.rf, x.image AS li, y.image AS ri, x.sha256 = y.sha256 AS exact,
                   CASE WHEN x.sha256 = y.sha256 THEN 0 ELSE bit_count(xor(x.phash, y.phash)) END AS d,
                   least(least(x.width * x.height, {K.MAX_IMAGE_WEIGHT}), least(y.width * y.height, {K.MAX_IMAGE_WEIGHT})) AS w,
                   least(x.width, y.width) * least(x.height, y.height) AS size
            FROM {cand} c JOIN shown x ON x.file = c.lf JOIN shown y ON y.file = c.rf
            WHERE x.sha256 = y.sha256 OR bit_count(xor(x.phash, y.phash)) <= {c.phash_distance}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY lf, rf ORDER BY {order}) AS k FROM met),
    walk AS (SELECT lf, rf, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS large FROM {cand}
             UNION ALL
             SELECT o.lf, o.rf, o.k,
                    CASE WHEN list_contains(s.ls, o.li) OR list_contains(s.rs, o.ri) THEN s.ls ELSE list_append(s.ls, o.li) END,
                    CASE WHEN list_contains(s.ls, o.li) OR list_contains(s.rs, o.ri) THEN s.rs ELSE list_append(s.rs, o.ri) END,
                    s.w + CASE WHEN list_contains(s.ls, o.li) OR list_contains(s.rs, o.ri) THEN 0 ELSE o.w END,
                    s.n + CASE WHEN list_contains(s.ls, o.li) OR list_contains(s.rs, o.ri) THEN 0 ELSE 1 END,
                    s.large + CASE WHEN list_contains(s.ls, o.li) OR list_contains(s.rs, o.ri) OR o.size < {K.LARGE_IMAGE_AREA} OR s.n >= {K.MAX_IMAGE_MATCHES} THEN 0 ELSE 1 END
             FROM walk s JOIN ordered o ON o.lf = s.lf AND o.rf = s.rf AND o.k = s.k + 1),
    walked AS (SELECT lf, rf, max(w) AS w, max(n) AS n, max(large) AS large FROM walk GROUP BY lf, rf HAVING max(n) > 0),
    weight AS (SELECT file, sum(least(width * height, {K.MAX_IMAGE_WEIGHT})) AS total FROM shown GROUP BY file),
    image_match AS (SELECT m.lf, m.rf, least(1.0, m.w / CAST(least(x.total, y.total) AS DOUBLE)) AS image_score, least(m.n, {K.MAX_IMAGE_MATCHES}) AS matches, m.large
                    FROM walked m JOIN weight x ON x.file = m.lf JOIN weight y ON y.file = m.rf)"""


def _text_stage(corpus: str, c: AnalysisConfig) -> str:
    target, step, k = c.target_chunk_chars, c.target_chunk_chars - c.chunk_overlap_chars, c.shingle_size
    return f"""{_PAGES[corpus]},
    total AS (SELECT count(*) AS n FROM files_in),
    cut AS (SELECT file, page, string_split_regex(text, '\\r?\\n') AS ls FROM corpus),
    raw_line AS (SELECT file, page, CAST(i AS INTEGER) AS line_no, ls[i + 1] AS raw FROM (SELECT file, page, ls, unnest(range(0, len(ls))) AS i FROM cut)),
    line AS (SELECT * FROM (SELECT file, page, line_no, {_normal("raw")} AS line FROM raw_line) WHERE line <> ''),
    freq AS (SELECT file, line, count(DISTINCT page) AS pages FROM line GROUP BY ALL),
    least_pages AS (SELECT file, greatest({K.HEADER_PAGES}, count(*) // 20) AS least FROM corpus GROUP BY file),
    headers AS (SELECT file, line FROM freq JOIN least_pages USING (file) WHERE length(line) <= {K.HEADER_CHARS} AND pages >= least),
    body AS (SELECT file, page, string_agg(line, ' ' ORDER BY line_no) AS text FROM line ANTI JOIN headers USING (file, line) GROUP BY ALL),
    clean AS (SELECT c.file, c.page, coalesce(b.text, '') AS text, length(coalesce(b.text, '')) AS char_count FROM corpus c LEFT JOIN body b USING (file, page)),
    win AS (SELECT file, page, text, char_count,
                   unnest(range(0, CASE WHEN char_count <= {target} THEN 1 ELSE 1 + CAST(ceil((char_count - {target}) / {step}.0) AS BIGINT) END)) AS i
            FROM clean WHERE char_count >= {c.min_chunk_chars}),
    piece AS (SELECT file, page, i * {step} AS start, least(i * {step} + {target}, char_count) AS "end", text FROM win),
    chunk AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY page, start) - 1 AS INTEGER) AS chunk, page, start, "end",
                     substring(text, CAST(start + 1 AS INTEGER), CAST("end" - start AS INTEGER)) AS text
              FROM piece WHERE "end" - start >= {k}),
    chunk_n AS (SELECT file, count(*) AS chunk_count FROM chunk GROUP BY file),
    shingle AS (SELECT DISTINCT file, chunk, {_hash64("gram", k)} AS h
                FROM (SELECT DISTINCT file, chunk, substring(text, CAST(i AS INTEGER), {k}) AS gram
                      FROM (SELECT file, chunk, text, unnest(range(1, length(text) - {k} + 2)) AS i FROM chunk))),
    sketch AS (SELECT file, chunk, h FROM (SELECT *, row_number() OVER (PARTITION BY file, chunk ORDER BY h) AS r FROM shingle) WHERE r <= {K.SKETCH_SIZE}),
    feature AS (SELECT h, count(*) AS postings, count(DISTINCT file) AS df FROM sketch GROUP BY h
                HAVING count(*) BETWEEN 2 AND {K.MAX_POSTING} AND count(DISTINCT file) BETWEEN 2 AND (SELECT CASE WHEN n >= 4 THEN least((n + 1) // 2, {K.MAX_FEATURE_FILES}) ELSE n END FROM total)),
    weighed AS (SELECT s.file, s.chunk, s.h, greatest(0.1, ln((SELECT n FROM total) / (1.0 + f.df))) AS w FROM sketch s JOIN feature f USING (h)),
    chunk_pair AS (SELECT a.file AS lf, a.chunk AS lc, b.file AS rf, b.chunk AS rc, count(*) AS shared, sum(a.w) AS weight
                   FROM weighed a JOIN weighed b ON a.h = b.h AND a.file < b.file GROUP BY ALL),
    raw AS (SELECT lf, rf, sum(weight) AS raw FROM chunk_pair GROUP BY ALL),
    enough AS (SELECT * FROM chunk_pair WHERE shared >= {c.min_shared_shingles}),
    evidence AS (SELECT lf, rf, any_value(raw.raw) AS raw, count(*) AS matches, max(shared) AS most, count(DISTINCT lc) AS left_chunks, count(DISTINCT rc) AS right_chunks,
                        (SELECT greatest(1.0, max(raw)) FROM raw) AS most_raw
                 FROM enough JOIN raw USING (lf, rf) GROUP BY lf, rf HAVING count(*) >= 2 OR max(shared) >= {K.STRONG_SHARED}),
    scored AS (SELECT * FROM (SELECT e.lf, e.rf, e.most,
                      0.15 * least(1.0, e.raw / e.most_raw) + 0.75 * least(e.left_chunks / CAST(x.chunk_count AS DOUBLE), e.right_chunks / CAST(y.chunk_count AS DOUBLE), 1.0) + 0.10 * least(1.0, e.matches / 12.0) AS score
               FROM evidence e JOIN chunk_n x ON x.file = e.lf JOIN chunk_n y ON y.file = e.rf) WHERE score >= {c.candidate_score_threshold} OR most >= {K.LOCAL_SHARED}),
    ends AS (SELECT lf, rf, lf AS file, round(score, 9) AS s FROM scored UNION ALL SELECT lf, rf, rf, round(score, 9) FROM scored),
    best AS (SELECT DISTINCT lf, rf FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, lf, rf) AS r FROM ends) WHERE r <= {c.candidate_top_k_per_file}),
    text_cand AS (SELECT lf, rf, score FROM scored SEMI JOIN best USING (lf, rf))"""


def _compare_stage(cand: str, c: AnalysisConfig) -> str:
    return f"""
    occurrence AS (SELECT file, page, text, char_count, row_number() OVER (PARTITION BY file, text ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY file, text) AS m FROM clean WHERE char_count >= 1),
    exact_page AS (SELECT c.lf, c.rf, x.page AS left_page, y.page AS right_page, x.char_count
                   FROM {cand} c JOIN occurrence x ON x.file = c.lf JOIN occurrence y ON y.file = c.rf AND y.text = x.text
                   WHERE y.i = CASE WHEN x.i = 0 THEN 0 ELSE y.m - x.i END),
    ranked AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY lf, rf ORDER BY shared DESC, lc, rc) AS rank
                              FROM chunk_pair p SEMI JOIN text_cand USING (lf, rf) WHERE shared >= {c.min_shared_shingles}) WHERE rank <= {K.MAX_CHUNK_COMPARISONS}),
    needed AS (SELECT lf AS file, lc AS chunk FROM ranked UNION SELECT rf, rc FROM ranked),
    own AS (SELECT s.* FROM shingle s SEMI JOIN needed USING (file, chunk)),
    size AS (SELECT file, chunk, count(*) AS n FROM own GROUP BY ALL),
    bits AS (SELECT file, chunk, i, sum((h >> i) & 1) AS ones, count(*) AS n FROM own, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL),
    simhash AS (SELECT file, chunk, {_majority("bits")}),
    common_h AS (SELECT r.lf, r.lc, r.rf, r.rc, count(*) AS c FROM ranked r JOIN own x ON x.file = r.lf AND x.chunk = r.lc JOIN own y ON y.file = r.rf AND y.chunk = r.rc AND y.h = x.h GROUP BY ALL),
    measured AS (SELECT r.lf, r.lc, r.rf, r.rc, r.rank, r.shared, {_hash60("x.text")} = {_hash60("y.text")} AS same, coalesce(o.c, 0) / CAST(p.n + q.n - coalesce(o.c, 0) AS DOUBLE) AS jaccard,
                        CAST(bit_count(xor(u.simhash, v.simhash)) AS INTEGER) AS distance, r.shared / CAST(greatest(1, least(p.n, q.n)) AS DOUBLE) AS ratio,
                        x.page AS lpage, y.page AS rpage, x.start AS lstart, x."end" AS lend, y.start AS rstart, y."end" AS rend, x.text AS ltext, y.text AS rtext
                 FROM ranked r JOIN chunk x ON x.file = r.lf AND x.chunk = r.lc JOIN chunk y ON y.file = r.rf AND y.chunk = r.rc
                 JOIN size p ON p.file = r.lf AND p.chunk = r.lc JOIN size q ON q.file = r.rf AND q.chunk = r.rc
                 JOIN simhash u ON u.file = r.lf AND u.chunk = r.lc JOIN simhash v ON v.file = r.rf AND v.chunk = r.rc
                 LEFT JOIN common_h o ON o.lf = r.lf AND o.lc = r.lc AND o.rf = r.rf AND o.rc = r.rc),
    verified AS (SELECT * FROM measured WHERE same OR jaccard >= {c.text_threshold} OR (distance <= {c.simhash_hamming_threshold} AND ratio >= {K.SHARED_RATIO})),
    open_pair AS (SELECT *, row_number() OVER (PARTITION BY lf, rf ORDER BY rank) AS k FROM verified v
                  WHERE NOT EXISTS (SELECT 1 FROM exact_page e WHERE e.lf = v.lf AND e.rf = v.rf AND (e.left_page = v.lpage OR e.right_page = v.rpage))),
    choose AS (SELECT DISTINCT lf, rf, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS ls, CAST([] AS INTEGER[]) AS rs, false AS taken FROM open_pair
               UNION ALL
               SELECT o.lf, o.rf, o.k,
                      CASE WHEN list_contains(s.ls, o.lc) OR list_contains(s.rs, o.rc) THEN s.ls ELSE list_append(s.ls, o.lc) END,
                      CASE WHEN list_contains(s.ls, o.lc) OR list_contains(s.rs, o.rc) THEN s.rs ELSE list_append(s.rs, o.rc) END,
                      NOT (list_contains(s.ls, o.lc) OR list_contains(s.rs, o.rc))
               FROM choose s JOIN open_pair o ON o.lf = s.lf AND o.rf = s.rf AND o.k = s.k + 1),
    matched AS (SELECT o.* FROM open_pair o JOIN choose s ON s.lf = o.lf AND s.rf = o.rf AND s.k = o.k WHERE s.taken),
    span AS (SELECT lf, rf, 'l' AS side, lpage AS page, lstart AS s, lend AS e FROM matched UNION ALL SELECT lf, rf, 'r', rpage, rstart, rend FROM matched
             UNION ALL SELECT lf, rf, 'l', left_page, 0, char_count FROM exact_page UNION ALL SELECT lf, rf, 'r', right_page, 0, char_count FROM exact_page),
    reach AS (SELECT *, coalesce(max(e) OVER (PARTITION BY lf, rf, side, page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM span),
    covered AS (SELECT lf, rf, side, sum(greatest(0, e - greatest(s, before))) AS n FROM reach GROUP BY ALL),
    chars AS (SELECT file, sum(char_count) AS n FROM clean GROUP BY file),
    text_score AS (SELECT c.lf, c.rf, c.score,
                          coalesce(least(a.n, b.n), 0) AS chars_matched,
                          CASE WHEN least(p.n, q.n) > 0 THEN least(1.0, coalesce(least(a.n, b.n), 0) / CAST(least(p.n, q.n) AS DOUBLE)) ELSE 0.0 END AS text_score,
                          (SELECT count(*) FROM exact_page e WHERE e.lf = c.lf AND e.rf = c.rf) AS exact_n,
                          (SELECT count(*) FROM matched m WHERE m.lf = c.lf AND m.rf = c.rf) AS approx_n
                   FROM {cand} c LEFT JOIN covered a ON a.lf = c.lf AND a.rf = c.rf AND a.side = 'l' LEFT JOIN covered b ON b.lf = c.lf AND b.rf = c.rf AND b.side = 'r'
                   LEFT JOIN chars p ON p.file = c.lf LEFT JOIN chars q ON q.file = c.rf)"""


def _pair_stage(c: AnalysisConfig, images: bool) -> str:
    source = "text_score t LEFT JOIN image_match i USING (lf, rf)" if images else "(SELECT *, 0.0 AS image_score, 0 AS matches, 0 AS large FROM text_score) t"
    image, n = "coalesce(image_score, 0.0)", "coalesce(matches, 0)"
    has_image = f"({n} >= 2 OR ({image} >= {c.image_threshold} AND coalesce(large, 0) > 0))"
    return f"""
    judged AS (SELECT lf, rf, score, text_score, {image} AS image_score, {n} AS image_n, exact_n, approx_n, chars_matched, exact_n + approx_n > 0 AS has_text, {has_image} AS has_image FROM {source}),
    final AS (SELECT *, CASE WHEN has_text AND has_image THEN greatest(text_score, 0.75 * text_score + 0.25 * image_score) WHEN has_text THEN text_score ELSE image_score END AS final_score
              FROM judged WHERE has_text OR has_image),
    pair AS (SELECT concat_ws('-', 'pair', lf, rf) AS pair_id, lf, rf, text_score, image_score, 0.0 AS page_image_score, final_score,
                    CASE WHEN final_score >= 0.85 THEN 'Extreme' WHEN final_score >= 0.7 THEN 'High' WHEN final_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS level,
                    exact_n AS exact_page_match_count, approx_n AS approximate_text_match_count, chars_matched AS matched_text_chars, CAST(image_n AS INTEGER) AS image_match_count,
                    CAST(least(exact_n + approx_n, {c.max_matches_per_pair}) AS INTEGER) AS text_evidence
             FROM final WHERE final_score >= {K.MIN_FINAL} OR score >= 1.0)"""


def _group_stage(c: AnalysisConfig) -> str:
    return f"""
    strong AS (SELECT * FROM pair WHERE final_score >= {c.final_threshold}),
    edge AS (SELECT lf AS a, rf AS b FROM strong UNION SELECT rf, lf FROM strong),
    reached AS (SELECT a AS file, a AS other FROM edge UNION SELECT r.file, e.b FROM reached r JOIN edge e ON e.a = r.other),
    component AS (SELECT file, min(other) AS root FROM reached GROUP BY file),
    relation AS (SELECT root, s.* FROM strong s JOIN component ON component.file = s.lf),
    member AS (SELECT root, count(*) AS n, string_agg(file, ',' ORDER BY file) AS file_ids FROM component GROUP BY root),
    measure AS (SELECT root, count(*) AS edges, avg(final_score) AS mean, bool_or(image_score > 0) AS images FROM relation GROUP BY root),
    dense AS (SELECT *, edges / CAST(greatest(1, n * (n - 1) // 2) AS DOUBLE) AS density FROM member JOIN measure USING (root)),
    grouped AS (SELECT *, least(1.0, 0.55 * mean + 0.45 * density) AS group_score FROM dense)"""


_B = PRESETS["balanced"]
_FLAT = """SELECT pair_id, lf, rf, round(text_score, 6) AS text_score, round(image_score, 6) AS image_score, page_image_score::DOUBLE AS page_image_score,
    round(final_score, 6) AS final_score, level, exact_page_match_count, approximate_text_match_count, CAST(matched_text_chars AS BIGINT) AS matched_text_chars, image_match_count, text_evidence FROM pair"""


def _text(select: str, corpus: str = "evidence", preset: str = "balanced") -> str:
    return f"WITH {_text_stage(corpus, PRESETS[preset])} {select}"


def _compared(select: str, corpus: str = "evidence") -> str:
    return f"WITH RECURSIVE {_text_stage(corpus, _B)}, {_compare_stage('text_cand', _B)}, {_pair_stage(_B, False)} {select}"


def _grouped(select: str) -> str:
    return f"WITH RECURSIVE {_text_stage('evidence', _B)}, {_compare_stage('text_cand', _B)}, {_pair_stage(_B, False)}, {_group_stage(_B)} {select}"


def _imaged(select: str) -> str:
    return f"WITH RECURSIVE {_IMAGES}, {_image_stage('40', _B)}, {_match_stage('image_cand', _B)} {select}"


_CAND = "cand AS (SELECT lf, rf, max(score) AS score FROM (SELECT * FROM text_cand UNION ALL SELECT * FROM image_cand) GROUP BY ALL)"
_FULL_TEXT = f"WITH RECURSIVE {_IMAGES}, {_text_stage('evidence+images', _B)}, {_image_stage('(SELECT n FROM total)', _B)}, {_CAND}"
_GLYPHS = "'[\\x{f0000}-\\x{fffff}]'"


def _shown(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, {_GLYPHS}) THEN '{UNREADABLE}'
        WHEN length({x}) > {K.PREVIEW_CHARS} THEN substring({x}, 1, {K.PREVIEW_CHARS}) || '...' ELSE {x} END"""


_EVIDENCE = f"""
    shown_text AS (SELECT e.lf, e.rf, 0 AS kind, e.left_page AS place, e.left_page, e.right_page, 1.0::DOUBLE AS similarity, c.text AS l, c.text AS r
                   FROM exact_page e JOIN clean c ON c.file = e.lf AND c.page = e.left_page
                   UNION ALL SELECT lf, rf, 1, rank, lpage, rpage, least(1.0, greatest(jaccard, ratio)), ltext, rtext FROM matched),
    listed AS (SELECT *, CAST(row_number() OVER (PARTITION BY lf, rf ORDER BY kind, place) AS INTEGER) AS n FROM shown_text)
    SELECT pair_id, n, left_page, right_page, round(similarity, 6) AS similarity, NOT (regexp_matches(l, {_GLYPHS}) OR regexp_matches(r, {_GLYPHS})) AS text_readable,
           {_shown("l")} AS left_text, {_shown("r")} AS right_text
    FROM listed JOIN pair USING (lf, rf) WHERE n <= {_B.max_matches_per_pair}"""

_PRINTED = """
    WITH split AS (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(regexp_replace(x, '[^ -~]+', '?', 'g'), ' ')) AS ls FROM documents),
    printed AS (SELECT 'doc-' || doc_id || '.pdf' AS file, CAST(p + 1 AS INTEGER) AS page, list_filter(ls[p * 8 + 1:p * 8 + 8], lambda x: x <> '') AS shown
                FROM (SELECT doc_id, ls, unnest(range(0, CAST(ceil(len(ls) / 8.0) AS BIGINT))) AS p FROM split)),
    pages AS (SELECT file, page, array_to_string(shown, chr(10)) AS text FROM printed)"""

ORACLE_SQL: dict[str, str] = {
    "q_normalize_lines": _text("SELECT file, page, line_no, line FROM line", "page_texts"),
    "q_line_frequency": _text("SELECT file, line, pages FROM freq", "page_texts"),
    "q_clean_pages": _text("SELECT file, page, text, char_count FROM clean", "page_texts"),
    "q_clean_documents": _text("SELECT file, page, text, char_count FROM clean", "documents"),
    "q_previews": f"""SELECT match_id, NOT regexp_matches(left_text, {_GLYPHS}) AS readable, {_shown("left_text")} AS shown, {_normal("left_text")} AS normal
                      FROM (SELECT DISTINCT match_id, left_text FROM matched_texts)""",
    "q_chunks": _text(f'SELECT file, chunk, page, start, "end", text, {_hash60("text")} AS text_hash FROM chunk'),
    "q_shingle_stats": _text("SELECT file, chunk, CAST(count(*) AS INTEGER) AS shingles, min(h) AS least, max(h) AS greatest FROM shingle GROUP BY ALL"),
    "q_sketch": _text("SELECT file, chunk, h FROM sketch"),
    "q_posting_filter": _text("SELECT h, postings, df FROM feature"),
    "q_chunk_pairs": _text("SELECT lf, lc, rf, rc, shared, round(weight, 6) AS weight FROM chunk_pair"),
    "q_candidate_evidence": _text("SELECT lf, rf, round(raw, 6) AS raw, matches, most, left_chunks, right_chunks, round(most_raw, 6) AS most_raw FROM evidence"),
    "q_text_candidates": _text("SELECT lf, rf, round(score, 6) AS score FROM text_cand"),
    "q_text_candidates_fast": _text("SELECT lf, rf, round(score, 6) AS score FROM text_cand", preset="fast"),
    "q_text_candidates_deep": _text("SELECT lf, rf, round(score, 6) AS score FROM text_cand", preset="deep"),
    "q_text_candidates_exhaustive": _text("SELECT lf, rf, round(score, 6) AS score FROM text_cand", preset="exhaustive"),
    "q_document_candidates": _text("SELECT lf, rf, round(score, 6) AS score FROM text_cand", "documents"),
    "q_document_pairs": _compared(_FLAT, "documents"),
    "q_topk_per_file": _text("SELECT s.lf, s.rf, round(s.score, 6) AS score, t.lf IS NOT NULL AS kept FROM scored s LEFT JOIN text_cand t ON t.lf = s.lf AND t.rf = s.rf"),
    "q_simhash": _text(f"""SELECT file, chunk, {_majority("(SELECT file, chunk, i, sum((h >> i) & 1) AS ones, count(*) AS n FROM shingle, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL)")}"""),
    "q_jaccard_verify": _compared("SELECT lf, lc, rf, rc, shared, same, round(jaccard, 6) AS jaccard, distance, round(ratio, 6) AS ratio FROM verified"),
    "q_exact_pages": _compared("SELECT lf, rf, left_page, right_page, char_count FROM exact_page"),
    "q_greedy_chunk_matches": _compared("SELECT lf, lc, rf, rc FROM matched"),
    "q_coverage": _compared("""SELECT lf, rf, CAST(sum(greatest(0, lend - greatest(lstart, before))) AS BIGINT) AS covered
        FROM (SELECT *, coalesce(max(lend) OVER (PARTITION BY lf, rf, lpage ORDER BY lstart, lend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM matched) GROUP BY ALL"""),
    "q_pairs_text": _compared(_FLAT),
    "q_text_evidence": _compared("," + _EVIDENCE),
    "q_image_phash_bits": f"""WITH {_IMAGES} SELECT file, image, lower(lpad(hex(phash), 16, '0')) AS phash, sha256, width, height FROM image""",
    "q_image_common": _imaged("SELECT sha256 FROM common"),
    "q_image_exact_candidates": _imaged("SELECT lf, rf, score FROM exact_image"),
    "q_image_band_candidates": _imaged("SELECT lf, rf, round(score, 6) AS score FROM band_image"),
    "q_image_match": _imaged("SELECT lf, rf, round(image_score, 6) AS image_score, CAST(matches AS INTEGER) AS matches FROM image_match"),
    "q_merge_candidates": f"{_FULL_TEXT} SELECT lf, rf, round(score, 6) AS score FROM cand",
    "q_pairs_full": f"{_FULL_TEXT}, {_match_stage('cand', _B)}, {_compare_stage('cand', _B)}, {_pair_stage(_B, True)} {_FLAT}",
    "q_components": _grouped("SELECT file, root FROM component"),
    "q_groups": _grouped("""SELECT 'group-' || root AS group_id, n AS files, edges, round(density, 6) AS graph_density, round(group_score, 6) AS group_score,
        CASE WHEN group_score >= 0.85 THEN 'Extreme' WHEN group_score >= 0.7 THEN 'High' WHEN group_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS level,
        CASE WHEN images THEN 'text-and-image' ELSE 'text' END AS evidence_type, file_ids, CASE WHEN density < 0.5 THEN 'WeakConnection,NeedsManualReview' ELSE '' END AS flags FROM grouped"""),
    "q_group_relations": _grouped("SELECT root, lf, rf, round(final_score, 6) AS final_score, round(text_score, 6) AS text_score, exact_page_match_count FROM relation"),
    "q_group_exact_pages": _grouped("SELECT root, CAST(sum(exact_page_match_count) AS BIGINT) AS exact_pages FROM relation GROUP BY root"),
    "q_run_totals": _grouped("""SELECT (SELECT count(*) FROM text_cand) AS candidate_pairs, (SELECT count(*) FROM pair) AS confirmed_pairs, (SELECT CAST(sum(text_evidence) AS BIGINT) FROM pair) AS confirmed_text_matches,
        (SELECT CAST(sum(image_match_count) AS BIGINT) FROM pair) AS confirmed_image_matches, (SELECT count(*) FROM grouped) AS groups, (SELECT count(*) FROM grouped WHERE density < 0.5) AS weak_groups"""),
    "q_report_totals": """WITH f AS (SELECT id, max(lower(trim(status))) AS status, max(image_count) AS image_count FROM files WHERE id IS NOT NULL GROUP BY id)
        SELECT count(*) AS files, count(*) FILTER (status IN ('ready', 'cid-fallback', 'image-only')) AS ready_files,
               count(*) FILTER (NOT coalesce(status IN ('ready', 'cid-fallback', 'image-only'), false)) AS failed_files, CAST(sum(image_count) AS BIGINT) AS images FROM f""",
    "q_pairs_over_threshold": "SELECT pair_id, scored_at, final_score FROM (SELECT DISTINCT * FROM similarity_pairs) WHERE final_score >= 0.6 AND NOT isnan(final_score)",
    "q_group_members": _grouped("SELECT root, file FROM component"),
    "q_totals_over_threshold": """SELECT count(*) AS pairs, CAST(sum(exact_page_match_count) AS BIGINT) AS exact_pages, CAST(sum(approximate_text_match_count) AS BIGINT) AS approximate_matches,
        CAST(sum(matched_text_chars) AS BIGINT) AS chars FROM (SELECT DISTINCT * FROM similarity_pairs) WHERE final_score >= 0.6 AND NOT isnan(final_score)""",
    "q_pair_paths": """WITH p AS (SELECT id, max(path) AS path FROM files WHERE id IS NOT NULL GROUP BY id)
        SELECT pair_id, left_file_id, l.path AS left_path, right_file_id, r.path AS right_path
        FROM (SELECT DISTINCT pair_id, left_file_id, right_file_id FROM similarity_pairs) LEFT JOIN p l ON l.id = left_file_id LEFT JOIN p r ON r.id = right_file_id""",
    "q_pdf_files": _PRINTED + """ SELECT file, file AS name, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(1 AS BIGINT) AS image_count, CAST(1 AS BIGINT) AS indexed_image_count,
        CASE WHEN sum(length(text)) = 0 THEN 'image-only' ELSE 'ready' END AS status, CAST(NULL AS VARCHAR) AS error FROM pages GROUP BY file""",
    "q_pdf_pages": _PRINTED + " SELECT file, page, text FROM pages",
    "q_pdf_images": """SELECT 'doc-' || doc_id || '.pdf' AS file, CAST(0 AS BIGINT) AS image, 1 AS page, 64 AS width, 64 AS height,
        sha256(unhex('0000004000000040') || encode(repeat(md5(CAST(doc_id AS VARCHAR)), 128))) AS sha256 FROM documents""",
    "q_files_summary": _text("""SELECT f.file, coalesce(p.n, 0) AS page_count, CAST(coalesce(p.chars, 0) AS BIGINT) AS total_text_chars, coalesce(c.chunk_count, 0) AS chunk_count
        FROM files_in f LEFT JOIN (SELECT file, count(*) AS n, sum(char_count) AS chars FROM clean GROUP BY file) p USING (file) LEFT JOIN chunk_n c USING (file)"""),
}

#: Stage queries that run on the documents too.
DOCUMENT_STAGES = {
    "q_document_chunks": "q_chunks",
    "q_document_sketch": "q_sketch",
    "q_document_posting_filter": "q_posting_filter",
    "q_document_chunk_pairs": "q_chunk_pairs",
    "q_document_verify": "q_jaccard_verify",
    "q_document_groups": "q_groups",
}
ORACLE_SQL |= {name: ORACLE_SQL[stage].replace(_PAGES["evidence"], _PAGES["documents"]) for name, stage in DOCUMENT_STAGES.items()}
