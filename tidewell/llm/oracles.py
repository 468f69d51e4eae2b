"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import embeddings, fim, line_dedup, quality, secrets, winnowing

WORD, BLANK = r"[^\x20\x09-\x0D]+", line_dedup.BLANK


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    duck = {
        "replace_all": lambda x, regex, to: f"regexp_replace({x}, {_quote(regex)}, {_quote(to)}, 'g')",
        "matches": lambda x, regex: f"regexp_matches({x}, {_quote(regex)})",
        "distinct": lambda x: f"len(list_distinct(string_split({x}, '')))",
    }
    feats = secrets.feature_sql(**duck, path="coalesce(source, '')")
    cand, lead = _quote(secrets.CANDIDATE), f"regexp_extract(m, {_quote(secrets.LEAD)})"
    return f"""WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {cand}) AS cs, regexp_split_to_array(coalesce(text, ''), {cand}) AS gaps FROM documents),
      c AS (SELECT *, unnest(cs) AS m, generate_subscripts(cs, 1) AS i FROM d),
      b AS (SELECT *, CASE WHEN length(m) - length({lead}) >= 6 THEN {lead} ELSE '' END AS lead FROM c),
      n AS (SELECT doc_id, source, i - 1 AS ord, substr(m, length(lead) + 1) AS cand, right(gaps[i] || lead, {secrets.LEFT}) AS lhs, left(gaps[i + 1], {secrets.RIGHT}) AS rhs FROM b WHERE lead <> '' OR regexp_matches(m, {_quote('(?s)' + secrets.LIKELY)})),
      f AS (SELECT *, {', '.join(f'CAST({v} AS INTEGER) AS {k}' if k in _FLAGS else f'{v} AS {k}' for k, v in feats.items())} FROM n),
      v AS (SELECT *, {secrets.forest_sql(secrets.forest())} AS vote FROM f)
      SELECT doc_id, source, ord, substr(cand, 1, 4) || '...' AS preview, sha256(cand) AS cand_sha256, {', '.join(secrets.FEATURES)}, vote, vote >= {secrets.THRESHOLD} AS is_secret FROM v"""


_FLAGS = ("f_hex", "f_cred", "f_benign", "f_assign", "f_quoted", "f_path", "f_block", "f_prefix")


def _quality() -> str:
    ratios = " UNION ALL ".join(f"SELECT doc_id, lang, source, {_quote(n)} AS ratio, {a} * {quality.SCALE} // {b} AS v FROM m WHERE NOT base_failed AND {b} > 0" for n, a, b, _ in quality.RATIOS)
    names = [f"q{p}" for p in quality.PERCENTS]
    pick = ", ".join(f"list_sort(list(lower_edge))[(count(*) * {p} + 99) // 100] AS q{p}" for p in quality.PERCENTS)
    quants = lambda keys: f"SELECT {keys}ratio, count(*) AS n, {pick} FROM h GROUP BY {keys}ratio"
    from_level = ", ".join(f"CASE WHEN s.n >= {quality.MIN_ROWS} THEN s.{c} WHEN l.n >= {quality.MIN_ROWS} THEN l.{c} ELSE w.{c} END AS {c}" for c in names)
    beyond = lambda p: f"max(q{p} + {quality.SPREADS} * (q{p} - q50))"
    limits = ", ".join(f"{beyond(p)} FILTER (ratio = {_quote(n)}) AS max_{n}" for n, _, _, p in quality.RATIOS)
    limits += f", {beyond(quality.LOWER_PERCENT)} FILTER (ratio = {_quote(quality.LOWER)}) AS min_{quality.LOWER}"
    fine = quality.fine_sql("").replace(".0D", ".0::DOUBLE")
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
      w AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BLANK}')) AS lines FROM t),
      e AS (SELECT doc_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i, len(words) AS k FROM w),
      g AS (SELECT doc_id, i, w1 || ' ' || lead(w1, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(w1, 2) OVER (PARTITION BY doc_id ORDER BY i) AS gram FROM e),
      r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
      p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
      m0 AS (SELECT w.doc_id, lang, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
      m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m0),
      v AS ({ratios}), h AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS lower_edge FROM v),
      s AS ({quants('lang, source, ')}), l AS ({quants('lang, ')}), a AS ({quants('')}),
      q AS (SELECT s.lang, s.source, s.ratio, {from_level} FROM s JOIN l ON l.lang IS NOT DISTINCT FROM s.lang AND l.ratio = s.ratio JOIN a w ON w.ratio = s.ratio),
      lim AS (SELECT lang, source, {limits} FROM q GROUP BY lang, source)
      SELECT doc_id, {', '.join(quality.COUNTS)}, base_failed, NOT base_failed AND {fine} AS kept
      FROM m LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source"""


def _lines() -> str:
    split = "string_split(text, chr(10))"
    return f"""WITH l AS (SELECT source, unnest(list_distinct(list_filter({split}, lambda x: NOT regexp_matches(x, '{BLANK}')))) AS line FROM documents),
      often AS (SELECT source, line, count(*) AS c FROM l GROUP BY ALL HAVING count(*) >= {line_dedup.MIN_PAGES}),
      pages AS (SELECT source, count(*) AS p FROM documents GROUP BY source),
      bad AS (SELECT o.source, list(line) AS bad FROM often o JOIN pages p ON p.source IS NOT DISTINCT FROM o.source WHERE c > {line_dedup.RATIO}::DOUBLE * p GROUP BY o.source),
      k AS (SELECT doc_id, d.source, text, {split} AS a, CASE WHEN bad IS NULL THEN {split} ELSE list_filter({split}, lambda x: NOT list_contains(bad, x)) END AS b FROM documents d LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM d.source)
      SELECT doc_id, source, coalesce(len(a), 0) AS n_lines, coalesce(len(a) - len(b), 0) AS n_dropped, array_to_string(b, chr(10)) AS text FROM k"""


def _embeddings() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {embeddings.THRESHOLD}::DOUBLE),
      reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
      c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
      SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id"""


def _fim() -> str:
    before, after, inner = map(_quote, fim.MARKS)
    mark = "|".join(fim.MARKS)
    h = ", ".join(f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    joined = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
      t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {h} FROM d),
      c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS p, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS m,
        CASE WHEN text = '' OR regexp_matches(text, '{mark}') OR h3 % 100 >= {fim.CUT_PERCENT} THEN 'plain' WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
      s AS (SELECT *, {joined(1, 'p')} AS a, {joined('p + 1', 'm')} AS b, {joined('m + 1', 'n')} AS c FROM c),
      o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {before} || a || {after} || c || {inner} || b ELSE {after} || c || {before} || a || {inner} || b END AS out FROM s),
      r AS (SELECT *, string_split_regex(out, '{mark}') AS x FROM o)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars, sha256(out) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM r"""


def _benchmark() -> str:
    upper, word, span = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", winnowing.SPAN
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')"
    window = lambda i, k: f"array_to_string(list_slice(w, {i}, {i} + {k} - 1), ' ')"
    return f"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
      bw AS (SELECT DISTINCT item_id, least(len(w), {span}) AS k, {window('i', f'least(len(w), {span})')} AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - {span} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
      d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
      dw AS (SELECT r, i, k, {window('i', 'k')} AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
      h AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.k = dw.k),
      n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
      t AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS items FROM h GROUP BY r)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r"""


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": _fim(), "op13_benchmark_decontamination": _benchmark(), "op1_secret_scan": _secrets(), "op4_quality_rules": _quality(), "op5_line_dedup": _lines(), "op6_embedding_near_dedup": _embeddings()}
