"""Reference SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tallyroom.llm import divergence, lexical, linededup, ngram_lm, sharding, urlfilter

_BLANK = "[\\x20\\x09-\\x0D]+"


def crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS UBIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bytes_}), lambda crc, b: {step}), CAST(4294967295 AS UBIGINT))"


def crc32_bytes(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: one step for each byte, by the table of the 256 bytes' own steps."""
    steps = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (b & 1) * 3988292384
        steps.append(b)
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bytes_}), lambda crc, b: xor(crc >> 8, CAST({steps} AS UBIGINT[])[CAST(1 + (xor(crc, b) & 255) AS BIGINT)])), CAST(4294967295 AS UBIGINT))"


def _ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_filter() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    fits = []
    for rule, _ in rules:
        site, slash, path = rule.partition("/")
        fits.append(f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{slash + path}')")
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, (r, _) in zip(fits, rules, strict=True)) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in rules) + " END"
    d, parts = urlfilter.DAMPING, []
    for i in range(1, urlfilter.STEPS + 1):
        before = "seeds" if i == 1 else f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT s.kind, s.dst AS host, b.rank * s.share * {d} AS rank FROM shares s JOIN {before} b ON b.kind = s.kind AND b.host = s.src "
            f"UNION ALL SELECT kind, host, rank * {1 - d} FROM seeds) GROUP BY kind, host)"
        )
    return f"""WITH cut AS (SELECT page_id, html, {rest} AS rest FROM pages),
parsed0 AS (SELECT page_id, html, {_ascii_lower("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
parsed1 AS (SELECT *, {rule} AS rule FROM parsed0), parsed AS MATERIALIZED (SELECT *, {action} AS action FROM parsed1),
links AS (SELECT host AS src, {_ascii_lower('dst')} AS dst, 1.0::DOUBLE AS w FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)) AS dst FROM parsed WHERE host <> '')),
hosts AS (SELECT host, count(*)::DOUBLE AS w, string_split(host, '.') AS labels FROM parsed WHERE host <> '' GROUP BY host),
up AS (SELECT host, w, array_to_string(labels[i:], '.') AS part_of FROM hosts, LATERAL (SELECT unnest(range(2, len(labels))) AS i)),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS weight FROM (SELECT * FROM links UNION ALL SELECT host, part_of, w FROM up UNION ALL SELECT part_of, host, w FROM up) WHERE src <> dst GROUP BY src, dst),
dirs AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM dirs),
seen AS (SELECT host, count(*) FILTER (action = 'allow')::DOUBLE AS a, count(*) FILTER (action = 'block')::DOUBLE AS b FROM parsed WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, a / (SELECT sum(a) FROM seen) AS rank FROM seen WHERE a > 0 UNION ALL SELECT 'distrust', host, b / (SELECT sum(b) FROM seen) FROM seen WHERE b > 0),
{', '.join(parts)},
byhost AS (SELECT host, round(sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END), 12) AS trust, round(sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END), 12) AS distrust FROM r{urlfilter.STEPS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN distrust > trust * {urlfilter.RATIO} THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM parsed LEFT JOIN byhost USING (host)"""


def _line_dedup() -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in linededup.BLANKS)
    return f"""WITH lines AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10))), {blanks}) AS line FROM documents),
spread AS (SELECT line, min(doc_id) AS first_doc FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
lost AS (SELECT l.doc_id, list(DISTINCT l.line) AS gone FROM lines l JOIN spread s USING (line) WHERE l.doc_id > s.first_doc GROUP BY l.doc_id),
cut AS (SELECT d.doc_id, string_split(text, chr(10)) AS every, CASE WHEN gone IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, {blanks}))) END AS stays FROM documents d LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(coalesce(len(every), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(every) - len(stays), 0) AS BIGINT) AS n_removed, CAST(length(coalesce(array_to_string(stays, chr(10)), '')) AS BIGINT) AS kept_chars, md5(coalesce(array_to_string(stays, chr(10)), '')) AS kept_md5 FROM cut"""


def _tool_calls() -> str:
    return """WITH RECURSIVE calls AS (SELECT conv_id, turn, 'call-' || CAST(turn AS VARCHAR) AS call_id, CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'summarise' END AS name, text, length(text) AS n FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn AS result_turn, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant'),
linked AS (SELECT c.*, result_turn, content FROM calls c LEFT JOIN results r USING (conv_id, turn)),
deps AS (SELECT c.conv_id, c.turn, b.turn AS before FROM calls c JOIN calls b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 WHERE c.n % 2 = 0),
depth AS (SELECT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM deps d WHERE d.conv_id = c.conv_id AND d.turn = c.turn) UNION ALL SELECT d.conv_id, d.turn, level + 1 FROM depth x JOIN deps d ON d.conv_id = x.conv_id AND d.before = x.turn),
judged AS (SELECT l.*, level, n % 7 = 0 AS odd, n % 7 <> 0 AND n % 5 = 0 AS bare, n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = l.conv_id AND b.turn = l.turn - 2) AS lost FROM linked l JOIN depth USING (conv_id, turn)),
told AS (SELECT *, concat_ws('; ', CASE WHEN name = 'lookup' AND bare THEN 'missing limit' WHEN name <> 'summarise' AND odd THEN 'mistyped limit' WHEN name = 'summarise' AND NOT bare THEN 'unknown limit' END, CASE WHEN lost THEN 'uses unknown call-' || CAST(turn - 2 AS VARCHAR) END) AS problems FROM judged)
SELECT conv_id, call_id, name, turn, CAST(level AS INT) AS level, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) AS INT) AS position, CAST(CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results, result_turn, problems, problems = '' AS valid,
'{"arguments":{' || CASE WHEN bare THEN '' WHEN odd THEN '"limit":"' || CAST(n AS VARCHAR) || '",' ELSE '"limit":' || CAST(n AS VARCHAR) || ',' END || '"query":' || CAST(to_json(text) AS VARCHAR) || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical_json FROM told"""


def _backoff_lm() -> str:
    k = ngram_lm.K
    return f"""WITH docs AS (SELECT doc_id, {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 2 AS held_out, list_transform(list_filter(string_split_regex({_ascii_lower("coalesce(text, '')")}, '{_BLANK}'), lambda w: w <> ''), lambda w: 'w' || w) AS words FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, held_out, unnest(list_append(words, 'end')) AS w, unnest(list_prepend('begin', words)) AS h, unnest(list_prepend('begin', list_prepend('begin', words[:len(words) - 1]))[:len(words) + 1]) AS g FROM docs),
ones AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w), twos AS (SELECT h, w, count(*) AS chw FROM tokens WHERE NOT held_out GROUP BY h, w), threes AS (SELECT g, h, w, count(*) AS cghw FROM tokens WHERE NOT held_out GROUP BY g, h, w),
single AS (SELECT h, count(*) AS ch FROM tokens WHERE NOT held_out GROUP BY h), double AS (SELECT g, h, count(*) AS cgh FROM tokens WHERE NOT held_out GROUP BY g, h),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM ones),
found AS (SELECT t.doc_id, t.held_out, c, (coalesce(c, 0) + 1) / (n + 1 * (v + 1)) AS base, coalesce(ch, 0) AS ch, coalesce(chw, 0) AS chw, coalesce(cgh, 0) AS cgh, coalesce(cghw, 0) AS cghw, n FROM tokens t CROSS JOIN n LEFT JOIN ones USING (w) LEFT JOIN single USING (h) LEFT JOIN twos USING (h, w) LEFT JOIN double USING (g, h) LEFT JOIN threes USING (g, h, w)),
probs AS (SELECT *, (cghw + {k} * ((chw + {k} * base) / (ch + {k}))) / (cgh + {k}) AS p FROM found)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10(base)), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM probs GROUP BY doc_id, held_out"""


def _source_divergence() -> str:
    share = f"1 + (CAST({divergence.SCALE} AS HUGEINT) * ({{n}} + {divergence.ADDED})) // ({{total}} + {divergence.ADDED} * v)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_ascii_lower("coalesce(text, '')")} AS text FROM documents),
tokens AS MATERIALIZED (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= {divergence.MIN_DOCUMENTS}),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
cells AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v FROM groups g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source LEFT JOIN sizes s ON s.lang = g.lang GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, {share.format(n="coalesce(n, 0)", total="total")} AS p FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN cells c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, {share.format(n="n", total="total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM totals GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def _sharding() -> str:
    seed, k = sharding.SEED, sharding.SHARDS
    return f"""WITH docs AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, {crc32_bytes("coalesce(text, '')")} AS text_crc32 FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('{seed}:' || doc_id), source, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM docs),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / CAST(2 * n AS DOUBLE), md5('{seed}:' || coalesce(source, '')), source NULLS FIRST, r) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, CAST(place * {k} // total AS INT) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(place - (shard * total + {k - 1}) // {k} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM cut"""


def _lexical_search() -> str:
    words = "regexp_extract_all({}, '" + lexical._TERM + "')"
    return f"""WITH tokens AS MATERIALIZED (SELECT doc_id, unnest({words.format(_ascii_lower("coalesce(text, '')"))}) AS term FROM documents),
lengths AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({words.format(_ascii_lower("coalesce(text, '')"))}) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
gains AS MATERIALIZED (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS gain FROM tf JOIN w USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(k * gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {lexical.TOP}"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _url_filter(),
    "op2_line_dedup": _line_dedup(),
    "op4_tool_call_linking": _tool_calls(),
    "op10_backoff_lm": _backoff_lm(),
    "op11_source_divergence": _source_divergence(),
    "op12_sharding": _sharding(),
    "op13_lexical_search": _lexical_search(),
}
