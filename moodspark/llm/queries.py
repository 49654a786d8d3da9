"""The queries of the training-data operators, and SQL for those that SQL can express."""

from moodspark.llm import bpe, decontaminate, doubling, dualtree, fingerprints, jaccard, licenses, merkle, secrets, superkmers, tokenfiles, toxicity, warc

QUERIES = {
    "op1_warc_merge": warc.op1_warc_merge,
    "op2_toxicity_grammar": toxicity.op2_toxicity_grammar,
    "op3_one_permutation": fingerprints.op3_one_permutation,
    "op4_super_kmers": superkmers.op4_super_kmers,
    "op5_prefix_doubling": doubling.op5_prefix_doubling,
    "op6_token_group_join": jaccard.op6_token_group_join,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_secret_automaton": secrets.op8_secret_automaton,
    "op9_benchmark_bm25": decontaminate.op9_benchmark_bm25,
    "op10_license_templates": licenses.op10_license_templates,
    "op11_dual_tree": dualtree.op11_dual_tree,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others learn, compress, hash or match by rules that SQL has no terms for; their tests compare them with plain code.
ORACLES: dict[str, str] = {
    "op1_warc_merge": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM o""",
    "op4_super_kmers": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM d, generate_series(1, greatest(len(w) - 19, 0)) g(i)),
        r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, generate_series(0, 19) g(j)),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op6_token_group_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS t FROM d, generate_series(1, greatest(len(w) - 2, least(len(w), 1))) g(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n m ON c.a = m.doc_id JOIN n o ON c.b = o.doc_id WHERE 100 * x >= 90 * (m.n + o.n - x)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM d JOIN reach ON d.doc_id = reach.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY 1""",
    "op11_dual_tree": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.row AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.positive_rank ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, p.positive_rank::INTEGER AS positive_rank
        FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op13_merkle_manifest": """
        WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
        crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
        d AS (SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(fields || coalesce(strlen(text) || ':' || CASE WHEN damaged THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claimed
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS fields,
                coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 5 = 0, false) AS damaged FROM documents, crc)),
        p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
        g AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM p UNION ALL
            SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM g WHERE n > 1 GROUP BY tree, level, pos // 16, n),
        s AS (SELECT tree, level AS height, h AS subroot FROM g WHERE n = 1),
        u AS (SELECT 0 AS level, tree AS pos, subroot AS h, (SELECT count(*) FROM s) AS n FROM s UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
        siblings AS (SELECT p.tree, p.pos, q.level, q.pos AS k, q.h FROM p JOIN g q ON p.tree = q.tree AND q.n > 1 AND q.pos // 16 = (p.pos >> (4 * q.level)) // 16 AND q.pos <> p.pos >> (4 * q.level) UNION ALL
            SELECT p.tree, p.pos, 100 + u.level, u.pos, u.h FROM p JOIN u ON u.n > 1 AND u.pos // 16 = (p.tree >> (4 * u.level)) // 16 AND u.pos <> p.tree >> (4 * u.level)),
        proofs AS (SELECT tree, pos, sha256(string_agg(h, '' ORDER BY level, k)) AS proof FROM siblings GROUP BY tree, pos),
        f AS (SELECT tree, pos, 0 AS level, pos AS at, claimed AS h FROM p UNION ALL
            SELECT f.tree, f.pos, f.level + 1, f.at // 16, sha256(string_agg(CASE WHEN q.pos = f.at THEN f.h ELSE q.h END, '' ORDER BY q.pos)) FROM f JOIN g q ON q.tree = f.tree AND q.level = f.level AND q.n > 1 AND q.pos // 16 = f.at // 16 GROUP BY f.tree, f.pos, f.level, f.at),
        b AS (SELECT f.tree, f.pos, 0 AS level, f.tree AS at, f.h FROM f JOIN s ON f.tree = s.tree AND f.level = s.height UNION ALL
            SELECT b.tree, b.pos, b.level + 1, b.at // 16, sha256(string_agg(CASE WHEN u.pos = b.at THEN b.h ELSE u.h END, '' ORDER BY u.pos)) FROM b JOIN u ON u.level = b.level AND u.n > 1 AND u.pos // 16 = b.at // 16 GROUP BY b.tree, b.pos, b.level, b.at),
        r AS (SELECT level, h AS root FROM u WHERE n = 1)
        SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(proof, sha256('')) AS proof_sha256, b.h AS folded_root, b.h = r.root AS verified
        FROM p JOIN s ON p.tree = s.tree JOIN r ON true JOIN b ON p.tree = b.tree AND p.pos = b.pos AND b.level = r.level LEFT JOIN proofs o ON p.tree = o.tree AND p.pos = o.pos""",
}
