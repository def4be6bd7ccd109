"""SQL of the corpus queries, in DuckDB's dialect, for those that SQL can express.

op4 needs CRC-32 and op5 XXH64, which the dialect lacks, and op6 learns; tests hold those against brute force.
"""

from __future__ import annotations

from cadenza.llm.chat import ChatTemplate
from cadenza.llm.mixing import SCHEDULES, stretches
from cadenza.llm.quality_rules import _ENDS, BOILERPLATE, QualityRules
from cadenza.llm.queries import URL_RULES
from cadenza.llm.secrets import BROAD, KINDS

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = r"[\x20\x09-\x0D]"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    t = ChatTemplate()
    probe = _q("\\### Assistant: </turn> ok")
    found = " + ".join(f"(length(text) - length(replace(text, {_q(c)}, ''))) // {len(c)}" for c in ("\\", *t.reserved))
    around = sum(map(len, (*t.opening, t.closing)))
    legal = " OR ".join(f"(before = {_q(a)} AND role = {_q(role)})" for a, to in t.transitions.items() for role in to)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {probe}), (-7, 1, 'assistant', {probe})),
  s AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS before, last_value(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final, row_number() OVER w AS k, {around} + length(role) + length(text) + {found} AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
  f AS (SELECT *, CASE WHEN {legal} THEN NULL ELSE role || ' after ' || before END AS fault FROM s),
  g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, arg_min(fault, k) FILTER (fault IS NOT NULL) AS fault, any_value(final) AS final FROM f GROUP BY conv_id)
  SELECT * EXCLUDE (fault, final), fault IS NULL AND final = 'assistant' AS valid, coalesce(fault, CASE WHEN final <> 'assistant' THEN 'ends after ' || final END) AS first_fault FROM g"""


def _quality() -> str:
    r = QualityRules()
    marks = " OR ".join(f"ends_with(bare, {_q(c)})" for c in _ENDS)
    phrases = "|".join(BOILERPLATE)
    count = lambda pattern: f"len(regexp_extract_all(line, {_q(pattern)}))"

    def repeated(name: str, source: str, words: str, keys: str) -> str:
        """CTEs up to ``name`` (keys, n_repeat_words): words in windows that a list of words has twice or more."""
        grams = ", ".join("word" if k == 0 else f"lead(word, {k}) OVER o" for k in range(r.window))
        return f"""{name}_p AS (SELECT {keys}, unnest({words}) AS word, generate_subscripts({words}, 1) AS i FROM {source}), {name}_g AS (SELECT {keys}, i, array_to_string([{grams}], ' ') AS gram, lead(word, {r.window - 1}) OVER o IS NOT NULL AS full_ FROM {name}_p WINDOW o AS (PARTITION BY {keys} ORDER BY i)),
  {name}_d AS (SELECT {keys}, i, CASE WHEN full_ AND count(*) FILTER (full_) OVER (PARTITION BY {keys}, gram) > 1 THEN 1 ELSE 0 END AS dup FROM {name}_g),
  {name} AS (SELECT {keys}, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM (SELECT {keys}, max(dup) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN {r.window - 1} PRECEDING AND CURRENT ROW) AS hit FROM {name}_d) GROUP BY {keys})"""

    few = f"len(lw) >= {r.repeat_words} AND len(list_distinct(lw)) < {r.distinct_share}::DOUBLE * len(lw)"
    near = f"list_sum(list_transform(range(1, len(lw) + 1, {r.repeat_span}), lambda i: len(list_distinct(lw[i : i + {r.repeat_span - 1}])))) < {r.distinct_share}::DOUBLE * len(lw)"
    far = f"100 * coalesce(n_repeat_words, 0) > {r.max_repeat_percent} * len(lw)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT row, doc_id, text, regexp_extract_all(text, {_q(_WORD)}) AS words FROM d),
  {repeated('rp', 'w', 'words', 'row')},
  l AS (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (SELECT row, string_split(text, chr(10)) AS lines FROM d)),
  m AS (SELECT row, line, k, row_number() OVER (PARTITION BY row, line ORDER BY k) > 1 AS earlier, regexp_extract_all(line, {_q(_WORD)}) AS lw, regexp_replace(line, '{_SPACES}+$', '') AS bare, {count('[|»›•·]')} AS seps, {count('[.!?…。！？]')} AS stops FROM l),
  c AS (SELECT row, k, lw FROM m WHERE {few}), {repeated('lr', 'c', 'lw', 'row, k')},
  v AS (SELECT row, len(lw) AS n, len(array_to_string(lw, '')) AS chars, earlier, CASE WHEN len(lw) = 0 THEN NULL WHEN seps >= {r.nav_separators} AND 2 * seps >= len(lw) - seps THEN 'navigation' WHEN length(line) < {r.boilerplate_chars} AND regexp_matches(line, '(?i){phrases}') THEN 'boilerplate'
  WHEN len(lw) >= 3 AND len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&!?<>|~^_=+]{{2,}}$'))) > {r.marked_share}::DOUBLE * len(lw) THEN 'symbols' WHEN {few} AND ({near} OR {far}) THEN 'repetition'
  WHEN len(lw) > {r.bare_words} AND NOT ({marks}) AND stops * {r.bare_words} < len(lw) THEN 'punctuation' WHEN earlier AND len(lw) >= {r.repeated_words} THEN 'repeated' END AS fault FROM m LEFT JOIN lr USING (row, k)),
  x AS (SELECT row, CAST(coalesce(sum(chars) FILTER (fault IS NOT NULL), 0) AS BIGINT) AS removed_chars, count(*) FILTER (n > 0 AND earlier) AS n_dup_lines FROM v GROUP BY row),
  b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, removed_chars FROM w JOIN x USING (row) LEFT JOIN rp USING (row)),
  e AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM b) SELECT *, NOT base_failed AND word_chars - removed_chars >= {r.keep_share}::DOUBLE * greatest(1, word_chars) AS kept FROM e"""


def _urls() -> str:
    rules = ", ".join(f"({_q(h)}, {_q(p)}, {_q(a)})" for h, p, a in URL_RULES)
    return f"""WITH r(rhost, rpath, action) AS (VALUES {rules}), t AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  u AS (SELECT row, page_id, {_ASCII.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t), f AS (SELECT row, arg_max(rhost || rpath, 1000000 * len(string_split(rhost, '.')) + length(rpath)) AS rule, arg_max(action, 1000000 * len(string_split(rhost, '.')) + length(rpath)) AS action FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row)
  SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN f USING (row)"""


def _secrets() -> str:
    kinds = [*KINDS.items(), *BROAD.items()]
    one = " UNION ALL ".join(
        f"SELECT row, {n} AS rank, '{k}' AS kind, m, g, val, j FROM (SELECT row, unnest(regexp_extract_all(text, {_q(p)})) AS m, unnest(regexp_extract_all(text, {_q(p)}, {group})) AS val, unnest(list_resize(string_split_regex(text, {_q(p)}), len(regexp_extract_all(text, {_q(p)})))) AS g, unnest(range(len(regexp_extract_all(text, {_q(p)})))) AS j FROM d WHERE regexp_matches(text, {_q(p)})) WHERE m IS NOT NULL"
        for n, (k, (p, group, _)) in enumerate(kinds)
    )
    least = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in kinds) + " END"
    base = ", ".join(f"'{k}'" for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents), a AS ({one}),
  s AS (SELECT *, CAST(sum(length(m) + length(g)) OVER (PARTITION BY row, kind ORDER BY j) AS BIGINT) AS stop FROM a), f AS (SELECT row, rank, kind, val, stop - length(m) AS start, stop FROM s WHERE length(val) >= {least}),
  o AS (SELECT val, CASE WHEN count(DISTINCT coalesce(source, chr(0))) >= 3 OR (count(DISTINCT coalesce(source, chr(0))) >= 2 AND count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 10) THEN 'example' ELSE 'live' END AS verdict FROM f JOIN d USING (row) GROUP BY val), h AS (SELECT f.*, verdict FROM f JOIN o USING (val)),
  r AS (SELECT row, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ({base}) OR verdict = 'live') AS spans, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM h GROUP BY row)
  SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN r USING (row)"""


def _contamination() -> str:
    words = f"regexp_extract_all({_ASCII.format('coalesce(text, chr(32))')}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark), bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS size FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
  d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents), z AS (SELECT DISTINCT size FROM bw), dw AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN z ON len(w) >= size)),
  h AS (SELECT row, i, size, item FROM dw JOIN bw USING (win, size)), c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM h)) GROUP BY row), t AS (SELECT row, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY row)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)"""


def _mix() -> str:
    time, drawn = "CASE", []
    for k, schedule in enumerate(SCHEDULES):
        inner = integral = ""
        for t, passed, f, slope in reversed(stretches(schedule)):
            rest = f"greatest(share - {passed}::DOUBLE, 0)"
            inner += f" WHEN share >= {passed}::DOUBLE THEN {t}::DOUBLE + CASE WHEN {rest} > 0 THEN 2 * {rest} / ({f}::DOUBLE + sqrt(greatest({f * f}::DOUBLE + {2 * slope}::DOUBLE * {rest}, 0))) ELSE 0 END"
            integral += f" WHEN time >= {t}::DOUBLE THEN {passed}::DOUBLE + (time - {t}::DOUBLE) * ({f}::DOUBLE + {slope / 2}::DOUBLE * (time - {t}::DOUBLE))"
        time += f" WHEN rank % {len(SCHEDULES)} = {k} THEN least(1, CASE{inner} END)"
        drawn.append(f"t{k} * CASE{integral} END")
    classes = ", ".join(f"coalesce(sum(target) FILTER (rank % {len(SCHEDULES)} = {k}), 0) AS t{k}" for k in range(len(SCHEDULES)))
    return f"""WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_q(_WORD)})) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
  k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, CAST(source_size * 2 AS DOUBLE) AS most, sum(source_size) OVER () AS everything FROM s), w AS (SELECT *, [5, 2, 1][rank % 3 + 1]::DOUBLE AS weight FROM k),
  v AS (SELECT *, (1.5::DOUBLE * everything - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  x AS (SELECT *, (SELECT arg_min(level, (most / weight, rank)) FROM v WHERE most > level * weight) AS found FROM v), t AS (SELECT *, CASE WHEN found IS NULL THEN most ELSE least(most, found * weight) END AS target FROM x),
  o AS (SELECT z.doc_id, z.size, t.source_size, t.target, t.rank, CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - z.size AS BIGINT) AS off, CAST(floor(target) AS BIGINT) AS total FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
  p AS (SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS passes, CASE WHEN target > 0 THEN least(1, off / target) ELSE 1 END AS share FROM o), q AS (SELECT *, passes * size + greatest(0, least(size, total - passes * source_size - off)) AS taken, {time} END AS time FROM p),
  c AS (SELECT {classes}, sum(target) AS whole FROM t)
  SELECT doc_id, size, source_size, round(target, 6) AS target, taken, CAST(CASE WHEN size > 0 THEN (2 * taken + size) // (2 * size) ELSE 0 END AS INT) AS copies, round(CASE WHEN whole > 0 THEN least(1, ({' + '.join(drawn)}) / whole) ELSE 1 END, 9) AS position FROM q, c"""


def _warc() -> str:
    return """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


ORACLE = {"op1_chat_formatting": _chat(), "op2_quality_rules": _quality(), "op3_url_filters": _urls(), "op7_secret_scans": _secrets(), "op8_decontamination": _contamination(), "op9_mixing": _mix(), "op10_warc": _warc()}
