"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions.masking import FLAT
from ..functions.text import STOP_WORDS
from ..operators import tasks as grammar
from ..operators.store import LEDGER_BLOCK
from . import views as v

NOW = f"{v.NOW:.1f}::DOUBLE"
WORD = r"[\p{L}\p{N}]+"
FOLD = "strip_accents(lower({}))"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CHUNKS = f"""chunks AS (SELECT doc_id AS rowid, 'd' || doc_id AS id, source, lang AS type, text AS content,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {NOW} - (doc_id % 400) * 86400.0 END AS mtime FROM documents)"""
QUERIES = "queries AS (SELECT item_id AS qid, text, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM benchmark)"


def _index(chunks: str = "chunks", queries: str = "queries", words: str | None = None, pre: str = "") -> str:
    """CTEs toks, tf, stat, df, qt, hits, scores of the full-text ranking, with names prefixed by ``pre``."""
    words = words or r"regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')"
    return f"""{pre}toks AS (SELECT rowid, regexp_extract_all({FOLD.format('content')}, '{WORD}') AS t FROM {chunks}),
  {pre}tf AS (SELECT rowid, term, count(*) AS f FROM (SELECT rowid, unnest(t) AS term FROM {pre}toks) GROUP BY ALL),
  {pre}stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM {pre}toks),
  {pre}df AS (SELECT term, count(*) AS n FROM {pre}tf GROUP BY term),
  {pre}qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, {FOLD.format('unnest(' + words + ')')} AS term FROM {queries}) GROUP BY ALL),
  {pre}idf AS (SELECT term, n, greatest(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END, 0) AS idf FROM {pre}df, {pre}stat),
  {pre}scores AS (SELECT qid, tf.rowid, round(-sum(times * idf * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
    FROM {pre}qt qt JOIN {pre}idf USING (term) JOIN {pre}tf tf USING (term) JOIN {pre}toks toks ON toks.rowid = tf.rowid, {pre}stat GROUP BY qid, tf.rowid)"""


def _top(source: str, k: int, order: str, cols: str, by: str = "qid", rank: str = "rank") -> str:
    return f"SELECT {cols.replace('@', 'CAST(rn AS INTEGER) AS ' + rank)} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {source}) WHERE rn <= {k}"


OKAPI = """otoks AS (SELECT rowid, regexp_extract_all(lower(content), '[a-zàâäéèêëïîôùûüç0-9]+') AS t FROM chunks),
  otf AS (SELECT rowid, term, count(*) AS f FROM (SELECT rowid, unnest(t) AS term FROM otoks) GROUP BY ALL),
  ostat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM otoks),
  odf AS (SELECT term, ln((max(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM otf, ostat GROUP BY term),
  oqt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-zàâäéèêëïîôùûüç0-9]+')) AS term FROM queries) GROUP BY ALL),
  okapi AS (SELECT qid, otf.rowid, round(sum(times * idf * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
    FROM oqt JOIN odf USING (term) JOIN otf USING (term) JOIN otoks ON otoks.rowid = otf.rowid, ostat GROUP BY qid, otf.rowid HAVING sum(times * idf) > 0)"""
VECTORS = "vectors AS (SELECT vec_id AS rowid, 'v' || label || '_' || vec_id AS id, 's' || (vec_id % 5) AS source, CAST(label AS VARCHAR) AS type, embedding::DOUBLE[] AS e FROM embeddings)"
VQ = "vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"
L2 = "round(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6)"
COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


def _knn(where: str = "TRUE") -> str:
    pairs = f"(SELECT qid, rowid, {L2.format(a='e', b='q')} AS distance FROM vectors, vq WHERE {where})"
    return f"WITH {VECTORS}, {VQ} " + _top(pairs, 5, "distance, rowid", "qid, @, rowid, distance")


HCHUNKS = f"""nvec AS (SELECT count(*) AS n FROM embeddings),
  quality AS (SELECT doc_id AS rowid, max(quality) AS quality FROM labels GROUP BY doc_id),
  slots AS (SELECT c.*, CASE WHEN c.rowid % 10 <> 9 THEN c.rowid % n END AS vec_id FROM chunks c, nvec),
  hchunks AS (SELECT s.* EXCLUDE (vec_id), e.embedding::DOUBLE[] AS e, CASE WHEN quality IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, quality::DOUBLE)) END AS importance
    FROM slots s LEFT JOIN embeddings e USING (vec_id) LEFT JOIN quality USING (rowid))"""
HQUERIES = "hqueries AS (SELECT qid, kind, CASE WHEN qid % 3 = 0 THEN 'latest ' || text ELSE text END AS text, embedding::DOUBLE[] AS q FROM queries LEFT JOIN embeddings ON vec_id = qid)"
TEMPORAL = r"(?i)\b(recent|latest|current|now|today|yesterday|actuel|maintenant|aujourd''hui|hier)\b"


def _hybrid(vectors: bool = True, temporal_only: bool = False, dated: bool = False) -> str:
    queries = f"(SELECT * FROM hqueries WHERE regexp_matches(text, '{TEMPORAL}'))" if temporal_only else "hqueries"
    chunks = "hchunks"
    ctes = [CHUNKS, QUERIES, HCHUNKS, HQUERIES]
    if dated:
        ctes.append("""schunks AS (SELECT rowid, id, source, CASE WHEN rowid % 4 = 0 THEN 'session' ELSE type END AS type,
          CASE WHEN rowid % 4 = 0 THEN 'Session ' || lower(to_hex(rowid)) || ' - ' || strftime(DATE '2026-01-01' + CAST(rowid % 300 AS INTEGER), '%Y-%m-%d') || ' - notes' || chr(10) || content ELSE content END AS content,
          mtime, e, importance FROM hchunks)""")
        ctes.append("dq AS (SELECT qid, kind, 'session of ' || strftime(DATE '2026-01-01' + CAST((qid * 4) % 300 AS INTEGER), '%Y-%m-%d') || ' ' || text AS text, q FROM hqueries)")
        chunks, queries = "schunks", "dq"
    ctes.append(f"aq AS (SELECT * FROM {queries})")
    ctes.append(_index(chunks, "aq"))
    ctes.append("fts AS (" + _top("scores", 20, "score, rowid", "qid, @, rowid") + ")")
    pairs = f"(SELECT qid, rowid, {L2.format(a='e', b='q')} AS distance FROM {chunks}, aq WHERE e IS NOT NULL AND q IS NOT NULL)"
    ctes.append(f"allpairs AS {pairs}" if vectors else "allpairs AS (SELECT 0 AS qid, 0 AS rowid, 0.0 AS distance WHERE FALSE)")
    ctes.append("vec AS (" + _top("allpairs", 20, "distance, rowid", "qid, @, rowid") + ")")
    fuse = "SELECT coalesce(v.qid, f.qid) AS qid, coalesce(v.rowid, f.rowid) AS rowid, v.rank AS vec_rank, f.rank AS fts_rank, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0) AS rrf, {flag} AS session_date_match FROM {vec} v FULL OUTER JOIN {fts} f ON v.qid = f.qid AND v.rowid = f.rowid"
    ctes.append("pooled AS (" + fuse.format(flag="FALSE", vec="vec", fts="fts") + ")")
    source = "pooled"
    if dated:
        ctes.append("own AS (SELECT qid, rowid FROM aq JOIN schunks ON type = 'session' AND rowid % 300 = (qid * 4) % 300 AND rowid % 4 = 0)")
        ctes.append("dfts AS (" + _top("(SELECT scores.* FROM scores JOIN own USING (qid, rowid))", 20, "score, rowid", "qid, @, rowid") + ")")
        ctes.append("dvec AS (" + _top("(SELECT allpairs.* FROM allpairs JOIN own USING (qid, rowid))", 20, "distance, rowid", "qid, @, rowid") + ")")
        ctes.append("dpool AS (" + fuse.format(flag="TRUE", vec="dvec", fts="dfts") + ")")
        ctes.append("both_pools AS (SELECT * FROM dpool UNION ALL SELECT p.* FROM pooled p ANTI JOIN dpool d ON d.qid = p.qid AND d.rowid = p.rowid)")
        source = "both_pools"
    ctes.append(f"""scored AS (SELECT p.*, c.importance, exp(-coalesce(CASE WHEN coalesce(mtime, 0) <> 0 THEN greatest(0.0, ({NOW} - mtime) / 86400.0) END, 3650.0) / 90.0) AS recency,
      CASE WHEN regexp_matches(text, '{TEMPORAL}') THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END AS w FROM {source} p JOIN {chunks} c USING (rowid) JOIN aq USING (qid))""")
    ctes.append("final AS (SELECT *, round(rrf + (1.0::DOUBLE / 61) * (w * recency + 0.05::DOUBLE * importance), 9) AS final FROM scored)")
    extra = ", session_date_match" if dated else ""
    cols = f"qid, @, rowid, vec_rank, fts_rank, round(rrf, 8) AS rrf_score, round(recency, 8) AS recency_score, importance::DOUBLE AS importance_score, final AS final_score{extra}"
    return "WITH " + ",\n".join(ctes) + " " + _top("final", 10, "session_date_match DESC, final DESC, coalesce(vec_rank, 20 + fts_rank), rowid", cols)


FTS10 = "top AS (" + _top("scores", 10, "score, rowid", "qid, @, rowid") + ")"
GOLD = "gold AS (SELECT item_id AS qid, doc_id AS rowid FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RANKS = f"""{CHUNKS}, {QUERIES}, {_index()}, {FTS10}, {GOLD},
  ranks AS (SELECT q.qid, kind, first_rank FROM queries q LEFT JOIN (SELECT qid, min(rank) AS first_rank FROM top JOIN gold USING (qid, rowid) GROUP BY qid) USING (qid) WHERE q.qid IN (SELECT qid FROM gold))"""

STORE = """store AS (SELECT c.rowid, c.id, c.source, c.type, c.content, c.mtime, sha256(c.content) AS content_hash, 1.0::DOUBLE AS created_at, e.embedding
  FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.rowid)"""
BATCH = """batch AS (SELECT id, source, type, content, rowid * 3 AS batch_seq FROM chunks
  UNION ALL SELECT id, source, type, content || ' v2', rowid * 3 + 1 FROM chunks WHERE rowid % 2 = 0
  UNION ALL SELECT id || '+', source, type, content, rowid * 3 + 2 FROM chunks WHERE rowid % 7 = 0)"""


def _upsert(store: str, batch: str) -> str:
    return f"""last AS (SELECT * FROM {batch} QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_seq DESC) = 1),
  merged AS (SELECT s.rowid AS old_rowid, l.*, coalesce(s.created_at, 2.0::DOUBLE) AS created FROM last l LEFT JOIN {store} s USING (id)),
  numbered AS (SELECT *, coalesce(old_rowid, (SELECT coalesce(max(rowid), 0) FROM {store}) + row_number() OVER (PARTITION BY old_rowid IS NULL ORDER BY batch_seq)) AS rowid FROM merged)
  SELECT rowid, id, source, type, length(content) AS n_chars, sha256(content) AS content_hash, created AS created_at, FALSE AS has_vector FROM numbered
  UNION ALL SELECT rowid, id, source, type, length(content), content_hash, created_at, embedding IS NOT NULL FROM {store} WHERE id NOT IN (SELECT id FROM last)"""


LEDGER = f"""blocks AS (SELECT source, rowid // {LEDGER_BLOCK} AS block, min(type) AS type, count(*) AS n, sha256(string_agg(content_hash, '' ORDER BY rowid)) AS h FROM store GROUP BY ALL),
  ledger AS (SELECT source, min(type) AS type, {NOW} AS last_indexed, sha256(string_agg(h, '' ORDER BY block)) AS content_hash, CAST(sum(n) AS BIGINT) AS chunk_count FROM blocks GROUP BY source)"""

FACTS = """f0 AS (SELECT doc_id AS n, source, CASE WHEN doc_id % 15 = 0 THEN doc_id + 1 ELSE doc_id END AS shown FROM documents),
  facts AS (SELECT 'f' || n AS id, n, f0.source, replace(substr(text, 1, 5), chr(10), ' ') AS subject, replace(substr(text, 11, 30), chr(10), ' ') AS object,
    'd' || (n + CASE WHEN n % 35 = 0 THEN 10000000 ELSE 0 END) AS chunk_id, CASE WHEN n % 20 = 0 THEN 'd' || (n + 5) END AS superseded_by FROM f0 JOIN documents ON doc_id = shown),
  prov AS (SELECT id AS fact_id, source, CASE WHEN n % 3 = 0 THEN 'old ' || id END AS evidence, 'linked' AS status, 1.0::DOUBLE AS updated_at, CASE WHEN n % 4 = 0 THEN 5.0::DOUBLE END AS absent_since FROM facts WHERE n % 3 = 0 OR n % 4 = 0)"""
COMPACT = r"regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _present(obj: str, corpus: str) -> str:
    c = COMPACT.format
    numbers = f"list_transform(regexp_extract_all({obj}, '[0-9]+(?:[.,][0-9]+)?'), lambda x: {c('x')})"
    words = f"list_transform(regexp_extract_all({obj}, '\\p{{L}}{{4,}}'), lambda x: {c('x')})"
    inside = "len(list_filter({xs}, lambda x: NOT contains({corpus}, x))) = 0"
    return f"""({c(obj)} = '' OR contains({corpus}, {c(obj)}) OR CASE WHEN len({numbers}) > 0 THEN {inside.format(xs=numbers, corpus=corpus)} ELSE len({words}) > 0 AND {inside.format(xs=words, corpus=corpus)} END)"""


STOPS = "[" + ", ".join(_q(w) for w in STOP_WORDS) + "]"


def _prompt_tokens(text: str) -> str:
    return f"list_slice(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(regexp_extract_all(lower({text}), '[a-zA-ZÀ-ſ0-9_-]{{3,}}'), lambda w: NOT list_contains({STOPS}, w)), lambda w: [w])), lambda a, w: CASE WHEN list_contains(a, w[1]) THEN a ELSE a || w END), 1, 8)"


PROMPTS = "prompts AS (SELECT qid, CASE WHEN qid % 5 = 0 THEN text || ' INC-' || lpad(CAST(qid AS VARCHAR), 4, '0') ELSE text END AS text, 's' || (qid % 6) AS session_id, q FROM hqueries)"
NOTED = "noted AS (SELECT * REPLACE (CASE WHEN rowid % 2 = 0 THEN content || ' see inc-' || CASE WHEN rowid < 10000 THEN lpad(CAST(rowid AS VARCHAR), 4, '0') ELSE left(CAST(rowid AS VARCHAR), 4) END ELSE content END AS content) FROM hchunks)"
UNKNOWN = r"""asked AS (SELECT qid, unnest(regexp_extract_all(text, '\b[a-zA-Z]+-\d{4,}\b')) AS identifier FROM prompts),
  wanted AS (SELECT DISTINCT lower(identifier) AS x FROM asked),
  known AS (SELECT DISTINCT x FROM wanted JOIN noted ON contains(lower(content), x)),
  unknown AS (SELECT DISTINCT qid FROM asked WHERE lower(identifier) NOT IN (SELECT x FROM known))"""


def _phrases(chunks: str, queries: str, words: str) -> str:
    """Like ``_index`` for words that may have several terms (``inc-0005``): phrases by positions."""
    return f"""toks AS (SELECT rowid, regexp_extract_all({FOLD.format('content')}, '{WORD}') AS t FROM {chunks}),
  stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
  ph AS (SELECT qid, regexp_extract_all({FOLD.format('unnest(' + words + ')')}, '{WORD}') AS terms FROM {queries}),
  qt AS (SELECT qid, array_to_string(terms, ' ') AS phrase, count(*) AS times FROM ph WHERE len(terms) > 0 GROUP BY ALL),
  pos AS (SELECT rowid, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM toks),
  parts AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) AS o, len(string_split(phrase, ' ')) AS n FROM (SELECT DISTINCT phrase FROM qt)),
  hits AS (SELECT phrase, rowid, count(*) AS f FROM (SELECT phrase, rowid, p - o AS at FROM parts JOIN pos USING (term) GROUP BY phrase, rowid, p - o, n HAVING count(DISTINCT o) = n) GROUP BY ALL),
  idf AS (SELECT phrase, CASE WHEN ln((max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM hits, stat GROUP BY phrase),
  scores AS (SELECT qid, hits.rowid, round(-sum(times * idf * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
    FROM qt JOIN idf USING (phrase) JOIN hits USING (phrase) JOIN toks ON toks.rowid = hits.rowid, stat GROUP BY qid, hits.rowid)"""


def _coverage(prompts: str, hits: str, chunks: str) -> str:
    wanted = f"list_transform({_prompt_tokens('text')}, lambda w: {FOLD.format('w')})"
    return f"""SELECT h.qid, h.rowid, CAST(len(list_intersect(list_distinct(wanted), list_distinct(regexp_extract_all({FOLD.format('content')}, '[a-zA-ZÀ-ſ0-9_-]{{3,}}')))) AS INTEGER) AS covers
    FROM {hits} h JOIN {chunks} c USING (rowid) JOIN (SELECT qid, {wanted} AS wanted FROM {prompts}) USING (qid)"""


def _mask(text: str) -> str:
    for pattern, to in FLAT:
        back = to
        for g in "12":
            back = back.replace("$" + g, "\\" + g)
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(back)}, 'g')"
    return text


EACH_BEFORE = "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
CONTEXT_TEXT = r"trim(regexp_replace(regexp_replace(before, '\[(?:SUGGEST|PROPOSE)[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))"

RUNS = """runs AS (SELECT event_id AS id, event_type AS task_id, 'u' || (user_id % 7) AS stem, date_trunc('second', ts)::TIMESTAMP AS started_at, value AS duration_s, user_id,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 150 THEN 'timeout' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN 'skipped_tokens' ELSE 'ok' END AS status FROM events),
  real AS (SELECT * FROM runs WHERE NOT starts_with(status, 'skipped'))"""
DUE = "due AS (SELECT task_id, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE)) AS due FROM (SELECT DISTINCT task_id FROM runs))"
LAST = "last AS (SELECT ref, arg_max(status, id) AS status FROM (SELECT id, status, task_id AS ref FROM real UNION SELECT id, status, stem FROM real) GROUP BY ref)"
OUTPUTS = r"""outputs AS (SELECT 't' || (user_id % 24) AS task_id, id, status = 'ok' AS ok,
  CASE WHEN k % 97 = 0 THEN ' ' || chr(10) || ' ' ELSE 'done 2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z  state ' || CASE WHEN user_id % 6 = 5 THEN k % 2 ELSE id // 4000 END END AS output, epoch(started_at) AS finished_at FROM real),
  printed AS (SELECT *, sha256(trim(regexp_replace(regexp_replace(output, '[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?', '<ts>', 'g'), '\s+', ' ', 'g'))) AS fp FROM outputs),
  good AS (SELECT * REPLACE (CASE WHEN ok AND regexp_replace(output, '\s+', '', 'g') <> '' THEN fp END AS fp) FROM printed),
  begun AS (SELECT *, CASE WHEN fp = lag(fp) OVER (PARTITION BY task_id ORDER BY id) THEN 0 ELSE 1 END AS b FROM good),
  islands AS (SELECT *, sum(b) OVER (PARTITION BY task_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS island FROM begun),
  streaks AS (SELECT *, row_number() OVER (PARTITION BY task_id, island ORDER BY id) - 1 AS unchanged FROM islands),
  states AS (SELECT *, least(8, CAST(pow(2, least(unchanged // 20, 30)) AS BIGINT)) AS times FROM streaks)"""


def _rows(rows: list[tuple], cols: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "E" + _q(x.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({cols})"


def _written() -> str:
    return f"""arrived AS (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, 'd' || doc_id AS id, source, lang AS type, text || CASE WHEN doc_id % 100 = 0 THEN ' revised edition' ELSE '' END AS text FROM documents),
      written AS (SELECT rowid, id, source, type, {_mask('text')} AS content FROM arrived WHERE source <> 'src3')"""


def oracle_sql() -> dict[str, str]:
    written = f"WITH {_written()}, {QUERIES}, {_index(chunks='written')}"
    base = f"WITH {CHUNKS}, {QUERIES}, {_index()}"
    out = {
        "fts_terms": f"WITH {CHUNKS}, {QUERIES}, {_index()} SELECT term, CAST(sum(f) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 100",
        "fts_postings_stats": f"{base} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT CAST(sum(f) AS BIGINT) FROM tf) AS n_tokens, (SELECT count(*) FROM df) AS n_terms FROM stat",
        "bm25_fts_topk": base + " " + _top("scores", 10, "score, rowid", "qid, @, rowid, score"),
        "bm25_fts_filtered": base + " " + _top("(SELECT scores.* FROM scores JOIN chunks USING (rowid) WHERE type IN ('de', 'fr'))", 10, "score, rowid", "qid, @, rowid, score"),
        "bm25_okapi_topk": f"WITH {CHUNKS}, {QUERIES}, {OKAPI} " + _top("okapi", 10, "score DESC, rowid", "qid, @, rowid, score"),
        "knn_l2_topk": _knn(), "knn_pivots_topk": _knn(), "knn_pivots_filtered": _knn("type IN ('1', '2')"), "knn_prefilter_type": _knn("type IN ('1', '2')"), "knn_prefilter_source": _knn("source = 's3'"), "knn_id_prefix": _knn("id ILIKE 'V4_%'"),
        "knn_rowids": _knn("rowid IN (" + ", ".join(map(str, range(0, 200, 9))) + ")"),
        "knn_cosine_topk": f"WITH {VECTORS}, {VQ} " + _top(f"(SELECT qid, rowid, {COS.format(a='e', b='q')} AS similarity FROM vectors, vq)", 5, "similarity DESC, rowid", "qid, @, rowid, similarity"),
        "hybrid_priors": _hybrid(), "hybrid_temporal_query": _hybrid(temporal_only=True), "hybrid_bm25_only": _hybrid(vectors=False), "hybrid_dated": _hybrid(dated=True),
        "recall_by_kind": f"""WITH {RANKS} SELECT coalesce(kind, 'all') AS kind, round(avg(CASE WHEN first_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_3, round(sum(coalesce(1.0::DOUBLE / first_rank, 0)) / count(*), 6) AS mrr,
          count(first_rank) AS found, count(*) AS n FROM ranks GROUP BY ROLLUP (kind)""",
        "mrr_overall": f"WITH {RANKS} SELECT round(sum(coalesce(1.0::DOUBLE / first_rank, 0)) / count(*), 6) AS mrr, count(*) AS n FROM ranks",
        "found_at_10": f"WITH {RANKS} SELECT count(first_rank) AS found, count(*) AS n FROM ranks",
        "misses": f"WITH {RANKS} SELECT qid, first_rank FROM ranks WHERE first_rank IS NULL OR first_rank > 3",
        "truth_validation": f"WITH {GOLD}, more AS (SELECT * FROM gold UNION ALL SELECT 0, 99999999) SELECT item_id AS qid, 'no gold document' AS problem FROM benchmark WHERE item_id NOT IN (SELECT qid FROM more) UNION ALL SELECT qid, 'not in the corpus: ' || rowid FROM more WHERE rowid NOT IN (SELECT doc_id FROM documents)",
        "store_upsert_keep_last": f"WITH {CHUNKS}, {STORE}, {BATCH}, {_upsert('store', 'batch')}",
        "store_replace_source": f"WITH {CHUNKS}, {STORE}, {BATCH}, left_store AS (SELECT * FROM store WHERE source <> 'src3'), new AS (SELECT * FROM batch WHERE source = 'src3' AND batch_seq % 3 = 0), {_upsert('left_store', 'new')}",
        "store_delete_source": f"WITH {CHUNKS}, {STORE} SELECT rowid, id, source, type, length(content) AS n_chars, content_hash, created_at, embedding IS NOT NULL AS has_vector FROM store WHERE source <> 'src3'",
        "store_written": f"WITH {_written()} SELECT rowid, id, source, type, length(content) AS n_chars, sha256(content) AS content_hash FROM written",
        "bm25_after_writes": written + " " + _top("scores", 10, "score, rowid", "qid, @, rowid, score"),
        "bm25_after_writes_filtered": written + " " + _top("(SELECT scores.* FROM scores JOIN written USING (rowid) WHERE type = 'de')", 10, "score, rowid", "qid, @, rowid, score"),
        "fts_stats_after_writes": written + " SELECT n_docs, (SELECT CAST(sum(f) AS BIGINT) FROM tf) AS n_tokens, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings FROM stat",
        "vectors_by_hash": f"WITH {CHUNKS}, {STORE} SELECT content_hash, round(arg_max(embedding, rowid)[1]::DOUBLE, 6) AS first_value FROM store WHERE embedding IS NOT NULL GROUP BY 1",
        "embed_missing": f"WITH {CHUNKS}, {STORE}, {BATCH} SELECT sha256(content) IN (SELECT content_hash FROM store WHERE embedding IS NOT NULL) AS reused, count(*) AS n FROM batch GROUP BY 1",
        "source_ledger": f"WITH {CHUNKS}, {STORE}, {LEDGER} SELECT * FROM ledger",
        "is_indexed": f"WITH {CHUNKS}, {STORE}, {LEDGER}, asked AS (SELECT source, CASE WHEN chunk_count % 2 = 0 THEN content_hash ELSE 'other' END AS hash FROM ledger UNION ALL SELECT 'nowhere', 'x') SELECT asked.source, hash, coalesce(hash = content_hash, FALSE) AS indexed FROM asked LEFT JOIN ledger ON ledger.source = asked.source",
        "stats_by_type": f"WITH {CHUNKS}, {STORE} SELECT type, count(*) AS chunks, count(embedding) AS vectors FROM store GROUP BY type",
        "health": f"WITH {CHUNKS}, {STORE}, c AS (SELECT count(*) AS chunks, count(DISTINCT id) AS ids FROM store), v AS (SELECT count(*) AS vectors FROM embeddings) SELECT chunks, vectors, vectors - least(vectors, chunks) AS orphans, ids = chunks AND vectors - least(vectors, chunks) <= greatest(2, chunks // 1000) AS ok FROM c, v",
        "fact_capture": f"""WITH {FACTS}, succ AS (SELECT chunk_id AS superseded_by, min(id) AS superseded_fact_id FROM facts GROUP BY chunk_id),
          fresh AS (SELECT f.id, f.source, f.superseded_by, d.text AS content FROM facts f LEFT JOIN documents d ON 'd' || d.doc_id = f.chunk_id WHERE f.id NOT IN (SELECT fact_id FROM prov WHERE evidence IS NOT NULL)),
          made AS (SELECT id AS fact_id, fresh.source, content AS evidence, CASE WHEN content <> '' THEN sha256(content) END AS evidence_sha256, CASE WHEN content <> '' THEN 'linked' ELSE 'needs_review' END AS status, superseded_fact_id, {NOW} AS updated_at, absent_since
            FROM fresh LEFT JOIN succ USING (superseded_by) LEFT JOIN prov ON prov.fact_id = fresh.id)
          SELECT fact_id, source, sha256(evidence) AS evidence_key, evidence_sha256, status, superseded_fact_id, updated_at, absent_since FROM made
          UNION ALL SELECT fact_id, source, sha256(evidence), NULL, status, NULL, updated_at, absent_since FROM prov WHERE fact_id NOT IN (SELECT fact_id FROM made)""",
        "fact_reconcile": f"""WITH {FACTS}, m AS (SELECT f.id, f.chunk_id, f.source, 'd' || d.doc_id AS found, d.doc_id IS NOT NULL AND trim(object) <> '' AND contains(lower(d.text), lower(object)) AND contains(lower(d.text), lower(subject)) AS hit FROM facts f LEFT JOIN documents d ON d.source = f.source),
          g AS (SELECT id, any_value(chunk_id) AS chunk_id, count(found) AS chunks, count(*) FILTER (hit) AS n, min(found) FILTER (hit) AS one FROM m GROUP BY id)
          SELECT id, CASE WHEN n = 1 THEN one ELSE chunk_id END AS chunk_id, CASE WHEN n = 1 THEN 'linked' WHEN chunks > 0 THEN 'needs_review' ELSE 'source_missing' END AS status FROM g""",
        "fact_absence": f"""WITH {FACTS}, {CHUNKS}, texts AS (SELECT source, {COMPACT.format("string_agg(content, ' ' ORDER BY rowid)")} AS corpus, max(coalesce(mtime, 0)) AS m FROM chunks WHERE rowid % 4 <> 0 GROUP BY source),
          a AS (SELECT f.id, p.absent_since AS before, CASE WHEN coalesce(m, 0) = 0 THEN {NOW} ELSE least(m, {NOW}) END AS since, NOT {_present('object', "coalesce(corpus, '')")} AS absent FROM facts f LEFT JOIN texts USING (source) LEFT JOIN prov p ON p.fact_id = f.id)
          SELECT id, absent, CASE WHEN absent THEN coalesce(before, since) END AS absent_since, absent <> (before IS NOT NULL) AS changed FROM a""",
        "object_present": f"""SELECT doc_id, {_present('obj', 'corpus')} AS present FROM (SELECT doc_id, {COMPACT.format('text')} AS corpus,
          CASE doc_id % 4 WHEN 0 THEN 'about 98,4 % of ' || doc_id WHEN 1 THEN substr(text, 5, 20) WHEN 2 THEN 'zzzz yyyy' ELSE '' END AS obj FROM documents)""",
        "requested_date": "SELECT CAST(m AS BIGINT) AS n, date FROM " + _rows([(1, "2026-03-14"), (2, "2026-02-03"), (3, "2026-03-05"), (4, None), (5, None), (6, None), (7, None), (8, "2025-08-01"), (9, "2026-05-05"), (10, None), (11, None)], "m, date"),
        "requested_dates": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 < 3 THEN '2026-03-' || lpad(((conv_id + turn) % 28 + 1)::VARCHAR, 2, '0') END AS date FROM conversations",
        "header_dates": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 5 <> 0) THEN '2026-05-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date FROM documents",
        "header_date": "SELECT CAST(m AS BIGINT) AS n, date FROM " + _rows([(1, "2026-03-14"), (2, None), (3, "2026-03-15"), (4, None), (5, None), (6, "2026-01-02"), (7, None)], "m, date"),
        "ambient_tokens": f"SELECT conv_id, turn, array_to_string({_prompt_tokens('text')}, ' ') AS tokens FROM conversations",
        "fold_text": "SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents",
        "identifier_gate": f"WITH {CHUNKS}, {QUERIES}, {HCHUNKS}, {HQUERIES}, {PROMPTS}, {NOTED}, {UNKNOWN} SELECT qid FROM unknown",
        "coverage": f"WITH {CHUNKS}, {QUERIES}, {_phrases('chunks', 'queries', _prompt_tokens('text'))}, top6 AS ({_top('scores', 6, 'score, rowid', 'qid, @, rowid')}) {_coverage('queries', 'top6', 'chunks')}",
        "conversation_context": f"""SELECT conv_id, turn, CASE WHEN before IS NULL OR len(regexp_extract_all(text, '\\S+')) > 12 THEN '' WHEN length({CONTEXT_TEXT}) <= 600 THEN {CONTEXT_TEXT}
          ELSE substr({CONTEXT_TEXT}, 1, 300) || ' ... ' || right({CONTEXT_TEXT}, 300) END AS context FROM {EACH_BEFORE} WHERE role = 'user'""",
        "embed_text": f"""SELECT conv_id, turn, CASE WHEN room < 40 OR length(ctx) = 0 THEN head WHEN length(ctx) <= room THEN head || chr(10) || chr(10) || ctx
          ELSE head || chr(10) || chr(10) || left(ctx, (room - 5) // 2) || ' ... ' || right(ctx, (room - 5) // 2) END AS shown
          FROM (SELECT conv_id, turn, role, substr(text, 1, 350) AS head, 348 - length(substr(text, 1, 350)) AS room, coalesce(before, '') AS ctx FROM {EACH_BEFORE}) WHERE role = 'user'""",
        "mask_assignments": f"SELECT doc_id, md5(masked) AS masked_md5 FROM (SELECT doc_id, text, {_mask('text')} AS masked FROM documents) WHERE masked <> text",
        "masked_tail": f"SELECT doc_id, md5(right(masked, 2000)) AS tail_md5 FROM (SELECT doc_id, {_mask('right(text, 64000)')} AS masked FROM documents)",
        "rerank_overlap": base + f""", top20 AS ({_top('scores', 20, 'score, rowid', 'qid, @, rowid')}),
          r AS (SELECT t.qid, t.rowid, t.rank AS old_rank, len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '{WORD}')), list_distinct(regexp_extract_all(lower(substr(content, 1, 2000)), '{WORD}'))))::DOUBLE AS rerank_score
            FROM top20 t JOIN queries q USING (qid) JOIN chunks c USING (rowid)) """ + _top("r", 10, "rerank_score DESC, old_rank", "qid, @, rowid, rerank_score", rank="new_rank"),
        "rrf_fusion": base + f""", {OKAPI}, a AS ({_top('scores', 20, 'score, rowid', 'qid, @, rowid')}), b AS ({_top('okapi', 20, 'score DESC, rowid', 'qid, @, rowid')}),
          u AS (SELECT qid, 0 AS list_id, rank, rowid FROM a UNION ALL SELECT qid, 1, rank, rowid FROM b),
          g AS (SELECT qid, rowid AS key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_id * 1000 + rank) AS seen FROM u GROUP BY ALL)
          SELECT qid, key, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY seen) AS INTEGER) AS place FROM g""",
    }
    pairwords = f"(SELECT qid, array_to_string(list_slice(regexp_extract_all(text, '{WORD}'), 1, 2), '_') AS text FROM queries WHERE len(regexp_extract_all(text, '{WORD}')) >= 2)"
    out["bm25_phrase"] = f"WITH {CHUNKS}, {QUERIES}, pairs AS {pairwords}, {_phrases('chunks', 'pairs', '[text]')} " + _top("scores", 10, "score, rowid", "qid, @, rowid, score")
    out["hybrid_weighted_inmemory"] = f"""WITH {CHUNKS}, {QUERIES.replace('queries AS', 'queries0 AS')}, {HCHUNKS}, {HQUERIES.replace('FROM queries', 'FROM queries0')}, queries AS (SELECT * FROM hqueries), {OKAPI},
      near AS (SELECT qid, rowid, {COS.format(a='e', b='q')} AS s FROM hchunks, hqueries WHERE e IS NOT NULL AND q IS NOT NULL),
      a AS ({_top('okapi', 20, 'score DESC, rowid', 'qid, @, rowid, score')}), b AS (SELECT * FROM ({_top('near', 20, 's DESC, rowid', 'qid, @, rowid, s')}) WHERE s > 0),
      both_sides AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.rowid, b.rowid) AS rowid, score, s FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.rowid = b.rowid),
      shares AS (SELECT qid, rowid, coalesce(score / max(score) OVER (PARTITION BY qid), 0) AS bm, coalesce(s / max(s) OVER (PARTITION BY qid), 0) AS ve FROM both_sides),
      c AS (SELECT *, round(0.4::DOUBLE * bm + 0.6::DOUBLE * ve, 6) AS combined_score FROM shares) """ + _top("(SELECT * FROM c WHERE combined_score >= 0)", 10, "combined_score DESC, rowid", "qid, @, rowid, round(bm, 6) AS bm25_score, round(ve, 6) AS vector_score, combined_score")
    out["ambient_select"] = f"""WITH {CHUNKS}, {QUERIES}, {HCHUNKS}, {HQUERIES}, {PROMPTS}, {NOTED}, {UNKNOWN},
      ap AS (SELECT * FROM prompts WHERE len({_prompt_tokens('text')}) >= 2 AND qid NOT IN (SELECT qid FROM unknown)), {_phrases('noted', 'ap', _prompt_tokens('text'))},
      fts AS ({_top('scores', 6, 'score, rowid', 'qid, @, rowid')}),
      near AS (SELECT qid, rowid, {L2.format(a='e', b='q')} AS distance FROM noted, ap WHERE e IS NOT NULL AND q IS NOT NULL), vec AS ({_top('near', 6, 'distance, rowid', 'qid, @, rowid')}),
      cov AS ({_coverage('ap', 'fts', 'noted')}),
      u AS (SELECT qid, 0 AS l, rank, rowid FROM fts UNION ALL SELECT qid, 1, rank, rowid FROM vec),
      fused AS (SELECT qid, rowid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 100 + rank) AS seen, max(CASE WHEN l = 1 THEN 1 ELSE 0 END) = 1 AS semantic FROM u GROUP BY qid, rowid),
      ev AS (SELECT f.*, coalesce(covers, 0) AS covers, c.type, c.source, c.content, c.mtime FROM fused f LEFT JOIN cov USING (qid, rowid) JOIN noted c USING (rowid)),
      ok AS (SELECT *, trim(regexp_replace(substr(content, 1, 200), '\\s+', ' ', 'g')) AS whole FROM ev WHERE (semantic OR covers >= 2)
        AND ((semantic AND covers >= 2) OR NOT (coalesce(mtime, 0) <> 0 AND ({NOW} - mtime) / 86400.0 > 90))),
      one AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, seen, rowid) AS s FROM ok WHERE whole <> '')
      """ + _top("(SELECT * FROM one WHERE s = 1)", 2, "score DESC, seen, rowid", "qid, @, rowid, type, source, md5(substr(whole, 1, 170)) AS extract_md5", rank="pick")
    out |= _scheduling()
    return out


def _scheduling() -> dict[str, str]:
    import hashlib

    sha = lambda c: hashlib.sha1(c.encode()).hexdigest()[:10]
    tasks = [
        (4, "python3 /opt/jobs/sync.py --all", "interval", "15m", False, True, 900, None, None, None, 60, None, None, None, 600),
        (5, "bash /opt/jobs/rotate.sh", "interval", "15m", False, False, 900, None, None, None, 120, "sync", None, None, 600),
        (6, "echo hi", "interval", "15m", False, False, 900, None, None, None, 120, None, None, None, 600),
        (9, "python -m pkg.backup", "daily", "02:30", False, True, None, 2, 30, None, 120, None, 7200, 4, 7200),
        (10, "bash /opt/jobs/rotate.sh", "daily", "02:30", False, False, None, 2, 30, None, 120, None, None, None, 10800),
        (13, "node /srv/report.js", "weekly", "friday 17:45", True, False, None, 17, 45, 4, 120, "rotate", None, None, 10800),
        (14, "echo bad", "weekly", "friday 17:45", False, False, None, 17, 45, 4, 120, "nothing", None, None, 10800),
        (29, "df -h", "interval", "2h", False, True, 7200, None, None, None, 120, None, None, None, 600),
    ]
    ids = [(4, f"sync-{sha('python3 /opt/jobs/sync.py --all')}", "sync"), (5, "rotate", "rotate"), (6, f"echo-{sha('echo hi')}", "echo"), (9, f"backup-{sha('python -m pkg.backup')}", "backup"), (10, "rotate-2", "rotate"),
           (13, f"report-{sha('node /srv/report.js')}", "report"), (14, f"echo-{sha('echo bad')}", "echo"), (29, f"df-{sha('df -h')}", "df")]
    errors = [
        (14, f"catch-up outside 1 to {grammar.MAX_CATCHUP} seconds is ignored: echo bad"), (14, f"back-off outside {grammar.MIN_ADAPTIVE} to {grammar.MAX_ADAPTIVE} is ignored: echo bad"),
        (14, "waits for an unknown task: [depends:nothing] in echo bad"), (15, "task that waits for itself: sh self.sh"), (17, "no such interval: ## Every 0 minutes"), (18, "task under no schedule: echo lost"),
        (20, "no such time of day: ## Daily at 25:00"), (21, "no such day and time: ## Weekly on Someday at 10:00"), (22, "no schedule by events here: ## On event: boot"), (23, "heading without a known schedule: ## Every so often"),
        (25, "task under no schedule: echo after notes"), (27, "looks like a task but has no ` -- `: - [ ] `echo no separator`"),
    ]
    cols = "line_no, command, schedule_type, schedule_value, uses_tokens, local, interval_seconds, daily_hour, daily_minute, weekly_day, timeout, depends_on, catchup, adaptive, window_s"
    kinds = {"line_no": "INTEGER", "interval_seconds": "BIGINT", "daily_hour": "INTEGER", "daily_minute": "INTEGER", "weekly_day": "INTEGER", "timeout": "BIGINT", "catchup": "BIGINT", "adaptive": "BIGINT", "window_s": "BIGINT"}
    cast = ", ".join(f"CAST({c} AS {kinds[c]}) AS {c}" if c in kinds else c for c in cols.split(", "))
    series = lambda i, first, step: f"SELECT {_q(i)} AS task_id, unnest(generate_series({first}, TIMESTAMP '2026-03-16 00:59:59', {step})) AS due"
    start = "TIMESTAMP '2026-03-02 01:00:00'"
    by = dict((n, i) for n, i, _ in ids)
    due = " UNION ALL ".join([
        series(by[4], start, "INTERVAL 15 MINUTE"), series(by[5], start, "INTERVAL 15 MINUTE"), series(by[6], start, "INTERVAL 15 MINUTE"), series(by[29], start, "INTERVAL 2 HOUR"),
        series(by[9], "TIMESTAMP '2026-03-02 02:30:00'", "INTERVAL 1 DAY"), series(by[10], "TIMESTAMP '2026-03-02 02:30:00'", "INTERVAL 1 DAY"),
        series(by[13], "TIMESTAMP '2026-03-06 17:45:00'", "INTERVAL 7 DAY"), series(by[14], "TIMESTAMP '2026-03-06 17:45:00'", "INTERVAL 7 DAY"),
    ])
    change = [(by[4], "added"), ("rotate", "changed"), (by[6], "kept"), (by[9], "kept"), ("rotate-2", "kept"), (by[13], "kept"), (by[14], "kept"), (by[29], "kept"), ("gone", "removed")]
    return {
        "parse_task_file": f"SELECT {cast} FROM " + _rows(tasks, cols),
        "task_ids": "SELECT CAST(line_no AS INTEGER) AS line_no, task_id, stem FROM " + _rows(ids, "line_no, task_id, stem"),
        "task_errors": "SELECT CAST(line_no AS INTEGER) AS line_no, error FROM " + _rows(errors, "line_no, error"),
        "due_times": due,
        "job_sync_diff": "SELECT * FROM " + _rows(change, "task_id, change"),
        "missed_runs": f"WITH {RUNS}, {DUE} SELECT task_id, due FROM due d WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.task_id = d.task_id AND r.started_at >= d.due AND r.started_at <= d.due + INTERVAL 10 MINUTE)",
        "overlap_runs": f"WITH {RUNS}, l AS (SELECT task_id, id, started_at, lag(id) OVER w AS previous_id, lag(started_at + to_microseconds(CAST(round(duration_s * 1000000) AS BIGINT))) OVER w AS e FROM real WINDOW w AS (PARTITION BY task_id ORDER BY started_at, id)) SELECT task_id, id, previous_id FROM l WHERE e > started_at",
        "coalesced_runs": f"""WITH {RUNS}, {DUE}, u AS (SELECT task_id, due AS t, 1 AS kind FROM due UNION ALL SELECT task_id, started_at, 0 FROM real),
          g AS (SELECT *, sum(1 - kind) OVER (PARTITION BY task_id ORDER BY t, kind DESC ROWS UNBOUNDED PRECEDING) AS gap FROM u) SELECT task_id, max(t) AS due, count(*) AS periods FROM g WHERE kind = 1 GROUP BY task_id, gap""",
        "last_status": f"WITH {RUNS}, {LAST} SELECT ref, status FROM last",
        "dependency_gate": f"WITH {RUNS}, {LAST}, t AS (SELECT task_id, CASE WHEN task_id = 'error' THEN 'never' ELSE 'u' || (max(id) % 7) END AS depends_on FROM runs GROUP BY task_id) SELECT task_id, depends_on, status, status IS DISTINCT FROM 'ok' AS blocked FROM t LEFT JOIN last ON ref = depends_on",
        "ran_since": f"WITH {RUNS}, m AS (SELECT task_id, max(started_at) AS m FROM runs GROUP BY task_id), a AS (SELECT task_id, m - INTERVAL 70 MINUTE AS since FROM m UNION ALL SELECT task_id, m + INTERVAL 1 SECOND FROM m) SELECT task_id, since, EXISTS (SELECT 1 FROM real r WHERE r.task_id = a.task_id AND r.started_at >= since) AS ran FROM a",
        "gate_verdicts": f"WITH {RUNS} SELECT task_id, CASE WHEN verdict = '@sync' THEN (SELECT CASE WHEN arg_max(status, id) = 'ok' THEN 'run' ELSE 'skipped_dependency' END FROM real WHERE task_id = 'click') ELSE verdict END AS verdict FROM "
        + _rows([(by[4], "run"), ("rotate", "@sync"), (by[6], "run"), (by[9], "skipped_adaptive"), ("rotate-2", "run"), (by[13], "skipped_tokens"), (by[14], "skipped_dependency"), (by[29], "run")], "task_id, verdict"),
        "recent_runs": f"WITH {RUNS} SELECT id, task_id, status, duration_s FROM runs ORDER BY id DESC LIMIT 20",
        "run_summary": f"WITH {RUNS} SELECT task_id, status, count(*) AS runs, round(sum(duration_s), 6) AS total_s, max(duration_s) AS longest_s, min(started_at) AS first_at, max(started_at) AS last_at FROM runs GROUP BY task_id, status",
        "repeated_hour": "SELECT * FROM " + _rows([(x, x == "2026-10-25 01:30:00") for x in v.INSTANTS], '"at", repeated'),
        "fingerprint": f"WITH {RUNS}, {OUTPUTS} SELECT fp AS fingerprint, count(*) AS n FROM printed GROUP BY fp",
        "adaptive_state": f"WITH {RUNS}, {OUTPUTS} SELECT task_id, fp AS fingerprint, unchanged, CASE WHEN fp IS NOT NULL AND times > 1 THEN finished_at + 900 * (times - 1) ELSE 0 END::DOUBLE AS skip_until FROM states QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY id DESC) = 1",
        "adaptive_skips": f"WITH {RUNS}, {OUTPUTS} SELECT task_id, id, unchanged, CAST(900 * (times - 1) AS BIGINT) AS wait_s FROM states WHERE fp IS NOT NULL AND times > 1",
        "stream_due_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_adaptive": """WITH e AS (SELECT event_type AS task_id, event_id AS id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 END AS fp FROM events),
          b AS (SELECT *, CASE WHEN fp = lag(fp) OVER (PARTITION BY task_id ORDER BY id) THEN 0 ELSE 1 END AS b FROM e), i AS (SELECT *, sum(b) OVER (PARTITION BY task_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS island FROM b),
          u AS (SELECT *, row_number() OVER (PARTITION BY task_id, island ORDER BY id) - 1 AS unchanged FROM i)
          SELECT task_id, count(*) AS runs, arg_max(unchanged, id) AS unchanged, max(unchanged) AS longest, least(8, CAST(pow(2, arg_max(unchanged, id) // 20) AS BIGINT)) AS times FROM u GROUP BY task_id""",
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    }
