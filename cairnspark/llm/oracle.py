"""DuckDB SQL for the registered queries that SQL can express.

Language ID (vectors), LM scoring (context trees), SentencePiece (a fold over a
model's pieces), substring dedup (hashed cuts), token counts and alignment
(libraries) have none; their tests compare
with brute force, the library, or held-out labels.
"""

from __future__ import annotations

from . import hamming, linededup, mixing, neardup, prefix_trie, quality, url_filter

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _urls() -> str:
    """The levels of the template tree, written out."""
    host = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))

    def choose(value):
        cases = []
        for kind, text in rules:
            name, _, tail = text.partition("/")
            cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}') THEN '{value(kind, text)}'")
        return "CASE " + " ".join(cases) + " END"

    out = rf"""WITH rests AS (SELECT page_id, coalesce({host}, '') AS rest FROM pages),
 u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {_UPPER}, {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
 shaped AS (SELECT page_id, host, path, string_split(regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '[0-9]+', '#', 'g'), '/') AS segs FROM u),
 lab AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
 known AS (SELECT page_id, max(bad) AS bad FROM u JOIN lab ON TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) = doc_id GROUP BY 1),
 t0 AS (SELECT host, segs, '' AS template, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, true AS open FROM shaped LEFT JOIN known USING (page_id) GROUP BY 1, 2)"""
    levels, m = 8, url_filter.MIN_LABELS  # more than paths have

    def differs(n, bad, all_n, all_bad):
        gap = f"({bad} / {n} - ({all_bad} - {bad}) / ({all_n} - {n}))"
        return f"{all_n} > {n} AND {all_bad} > 0 AND {all_bad} < {all_n} AND {gap} * {gap} >= {url_filter.Z2}::DOUBLE * ({all_bad} / {all_n}) * (1 - {all_bad} / {all_n}) * (1 / {n} + 1 / ({all_n} - {n}))"

    for i in range(levels):
        out += f""",
 c{i} AS (SELECT host, template, segs[{i + 1}] AS seg, sum(lab) AS cl, sum(bad) AS cb FROM t{i} WHERE open AND len(segs) > {i} GROUP BY 1, 2, 3),
 n{i} AS (SELECT host, template, sum(cl) AS pl, sum(cb) AS pb FROM c{i} GROUP BY 1, 2 HAVING sum(cb) > 0 AND sum(cb) < sum(cl) AND sum(cl) > {m}),
 o{i} AS (SELECT c.*, cb * pl > pb * cl AS high FROM c{i} c JOIN n{i} USING (host, template) WHERE cl >= {m} AND {differs("cl", "cb", "pl", "pb")}),
 a{i} AS (SELECT host, template, high, sum(cl) AS gl, sum(cb) AS gb, count(*) AS k, min(seg) AS first FROM o{i} GROUP BY 1, 2, 3),
 b{i} AS (SELECT host, template, seg, CASE WHEN k = 1 OR {differs("cl", "cb", "gl", "gb")} THEN CASE WHEN left(seg, 1) IN ('*', '(', chr(92)) THEN chr(92) || seg ELSE seg END ELSE '(' || first || '..)' END AS name FROM o{i} JOIN a{i} USING (host, template, high)),
 t{i + 1} AS (SELECT t.host, segs, lab, bad, open AND len(segs) > {i} AND n.host IS NOT NULL AS open,
   CASE WHEN NOT open OR len(segs) <= {i} THEN t.template ELSE t.template || '/' || CASE WHEN n.host IS NULL THEN '**' ELSE coalesce(name, '*') END END AS template
   FROM t{i} t LEFT JOIN n{i} n ON t.host = n.host AND t.template = n.template LEFT JOIN b{i} b ON t.host = b.host AND t.template = b.template AND segs[{i + 1}] = b.seg)"""
    last, prior = f"t{levels}", f"{url_filter.PRIOR}::DOUBLE"
    return out + f""",
 leaf AS (SELECT host, template, sum(lab) AS lab, sum(bad) AS bad FROM {last} GROUP BY 1, 2),
 hosts AS (SELECT host, (sum(bad) + {prior} * (SELECT sum(bad) FROM leaf) / (SELECT sum(lab) FROM leaf)) / (sum(lab) + {prior}) AS rate FROM leaf GROUP BY 1 HAVING (SELECT sum(lab) FROM leaf) > 0),
 rejected AS (SELECT host, template FROM leaf JOIN hosts USING (host) WHERE lab >= {url_filter.MIN_LABELS} AND (bad + {prior} * rate) / (lab + {prior}) >= {url_filter.REJECT}),
 gone AS (SELECT host, segs, template FROM {last} JOIN rejected USING (host, template))
SELECT page_id, s.host, path, {choose(lambda k, r: r)} AS rule,
  coalesce({choose(lambda k, r: k)}, CASE WHEN g.template IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, g.template AS template
FROM shaped s LEFT JOIN gone g ON s.host = g.host AND s.segs = g.segs""".replace("(host = '", "(s.host = '").replace("ends_with(host,", "ends_with(s.host,")


def _quality() -> str:
    unit, reach, k0 = quality.UNIT, quality.REACH, quality.PRIOR
    value = {m: f"({unit} * (2 * {k} + {one})) // (2 * ({n} + {one}))" for m, (k, n, one, _) in quality.SHARES.items()} | {"word_length": f"{unit} * word_chars // n_words"}
    shown = {m: f"{unit} * {k} // ({n})" for m, (k, n, *_) in quality.SHARES.items()} | {"word_length": f"{unit} * word_chars // n_words"}
    bucket = "(v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0)"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM d WHERE NOT ({quality.BASE_FAILED})" for m, v in value.items())
    tail = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, (*_, t) in quality.SHARES.items()) + f" ELSE {quality.LENGTH_TAIL} END"
    names = ("low", "mid", "high")

    def quantiles(name, keys):
        part = ", ".join([*keys, "metric"])
        return f"""{name}_m AS (SELECT {part}, bucket, sum(n) AS n FROM sk GROUP BY ALL),
 {name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {part}) AS docs, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, {tail} AS tail FROM {name}_m),
 {name} AS (SELECT {part}, max(docs)::BIGINT AS docs, min(bucket) FILTER (upto * 1000 >= (1000 - tail) * docs) AS low, min(bucket) FILTER (upto * 1000 >= 500 * docs) AS mid, min(bucket) FILTER (upto * 1000 >= tail * docs) AS high FROM {name}_c GROUP BY ALL)"""

    shrunk = ", ".join(f"(l.docs * l.{x} + {k0} * e.{x}) // (l.docs + {k0}) AS l_{x}" for x in names)
    take = ", ".join(f"(docs * {x} + {k0} * l_{x}) // (docs + {k0}) AS {x}" for x in names)
    least = quality.LENGTH_LEAST
    outside = [f"(f.metric = '{m}' AND {unit} * ({k} - {one}) > ({reach} * high * {unit}) // ({unit} - high + {reach} * high) * ({n}))" for m, (k, n, one, _) in quality.SHARES.items()]
    outside.append(f"(f.metric = 'word_length' AND (word_length > high + {reach} * greatest(high - mid, {least}) OR word_length < low - {reach} * greatest(mid - low, {least})))")
    return rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 tri AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM w)),
 rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1) GROUP BY 1),
 ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
 m AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
   len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
 d AS (SELECT *, {", ".join(f"CASE WHEN n_words > 0 THEN {e} END AS {k}" for k, e in shown.items())} FROM m),
 long AS ({long}), sk AS (SELECT lang, source, metric, {bucket} AS bucket, count(*) AS n FROM long GROUP BY ALL),
 {quantiles("own", ["lang", "source"])}, {quantiles("langs", ["lang"])}, {quantiles("every", [])},
 o AS (SELECT o.*, {shrunk} FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN every e ON o.metric = e.metric),
 f AS (SELECT lang, source, metric, {take} FROM o),
 far AS (SELECT DISTINCT d.doc_id FROM d JOIN f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source WHERE {" OR ".join(outside)}),
 b AS (SELECT *, {quality.BASE_FAILED} AS base_failed FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept, symbol_share, dup_line_share, repeat_share, word_length FROM b"""


_HAMMING = f"""WITH c AS (SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance FROM c q, c WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= {hamming.K}"""


def _lines() -> str:
    roll = " + ".join(["h"] + [f"coalesce(lag(h, {j}) OVER w, 0) * {pow(linededup.BASE, j, linededup.PRIME)} % {linededup.PRIME}" for j in range(1, linededup.WINDOW)])
    like = lambda a, b: f"coalesce(nullif(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: coalesce({a}[i] = {b}[i], false)), false), 0) - 1, len({a}))"
    r = linededup.REACH
    return rf"""WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 ls AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line, len(l) AS n FROM docs),
 hs AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT >> 1 AS h FROM ls),
 gs AS (SELECT *, ({roll}) % {linededup.PRIME} AS g FROM hs WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 ends AS (SELECT *, (i = n - 1 OR coalesce(lag(g) OVER w > g AND g <= lead(g) OVER w, false)
   OR coalesce(i % 2 = 0 AND lag(g, 2) OVER w = g AND lag(g) OVER w = g AND lead(g) OVER w = g, false))::INT AS e FROM gs WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 grp AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ends),
 chunks AS (SELECT doc_id, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS chunk FROM grp GROUP BY doc_id, c),
 many AS (SELECT * FROM chunks WHERE last > first AND regexp_matches(chunk, '[^\x20\x09-\x0D]')),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS r, count(*) OVER (PARTITION BY chunk) AS k FROM many),
 near AS (SELECT r.*, list_reverse(l[greatest(1, first - {r} + 1) : first]) AS before, l[last + 2 : last + 1 + {r}] AS after FROM ranked r JOIN docs USING (doc_id) WHERE k > 1),
 gone AS (SELECT x.doc_id, x.first, x.first - {like("x.before", "y.before")} AS a, x.last + {like("x.after", "y.after")} AS b FROM near x JOIN near y ON x.chunk = y.chunk AND y.r = 1 AND x.r > 1),
 chunk_count AS (SELECT doc_id, count(*) AS n_chunks FROM gone GROUP BY 1),
 out_lines AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM gone),
 lost AS (SELECT doc_id, count(*) AS n_lines FROM out_lines GROUP BY 1),
 kept AS (SELECT ls.doc_id, string_agg(line, chr(10) ORDER BY ls.i) AS text FROM ls ANTI JOIN out_lines o ON ls.doc_id = o.doc_id AND ls.i = o.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_chunks, 0)::BIGINT AS n_removed_chunks,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5 FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN chunk_count USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _mixing() -> str:
    def position(share):
        cases = []
        for w, knots in mixing.SCHEDULES.items():
            step, area = 1 / (len(knots) - 1), [0.0]
            for a, b in zip(knots, knots[1:], strict=False):
                area.append(area[-1] + step * (a + b) / 2)
            inner = "1.0::DOUBLE"
            for i in reversed(range(len(knots) - 1)):
                slope, left = (knots[i + 1] - knots[i]) / step, f"({share} * {area[-1]}::DOUBLE - {area[i]}::DOUBLE)"
                x = f"2 * {left} / ({knots[i]}::DOUBLE + sqrt(greatest(0, {knots[i] * knots[i]}::DOUBLE + 2 * {slope}::DOUBLE * {left})))"
                inner = f"CASE WHEN {share} * {area[-1]}::DOUBLE < {area[i + 1]}::DOUBLE THEN {i * step}::DOUBLE + {x} ELSE {inner} END"
            cases.append(f"WHEN weight = {w} THEN {inner}")
        return "CASE " + " ".join(cases) + " END"

    e = mixing.MAX_EPOCHS
    rounds, fills = 12, ""  # more than there are
    for i in range(rounds):
        left = "NOT fits AND size > 0 AND size <= gap"
        fills += f""",
 g{i} AS (SELECT *, rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM f{i}),
 h{i} AS (SELECT *, sum(CASE WHEN {left} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY start, size ROWS UNBOUNDED PRECEDING) AS upto FROM g{i}),
 f{i + 1} AS (SELECT * EXCLUDE (fits, gap, upto), fits OR ({left} AND upto <= gap) AS fits FROM h{i})"""
    fills += f""",
 gl AS (SELECT *, rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM f{rounds}),
 x AS (SELECT source, min((abs(gap - size), start))[2] AS extra FROM gl WHERE NOT fits AND size > 0 AND abs(gap - size) < gap GROUP BY 1),
 last AS (SELECT gl.* EXCLUDE (fits), fits OR coalesce(extra = start AND size > 0, false) AS fits FROM gl LEFT JOIN x ON gl.source IS NOT DISTINCT FROM x.source)"""
    return rf"""WITH s AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size,
   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || coalesce(source, 'null') || '#' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS u FROM documents),
 so AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
 wt AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {e} * source_size AS cap FROM so),
 lv AS (SELECT *, cap / weight AS level, sum(source_size) OVER () AS total FROM wt),
 wa AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM lv),
 lowest AS (SELECT arg_min(water, (level, source)) AS water FROM wa WHERE water <= level),
 goals AS (SELECT source, source_size, weight, least(cap::DOUBLE, coalesce((SELECT water FROM lowest), level) * weight) AS target FROM wa),
 gr AS (SELECT *, round(target)::BIGINT AS goal FROM goals),
 gf AS (SELECT *, CASE WHEN source_size > 0 THEN least({e}, goal // source_size) ELSE 0 END AS full_passes FROM gr),
 gg AS (SELECT *, greatest(0, CASE WHEN full_passes < {e} THEN goal - full_passes * source_size ELSE 0 END) AS rest FROM gf),
 st AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size) - size AS start FROM s),
 f0 AS (SELECT st.*, source_size, weight, target, full_passes, rest, false AS fits FROM st JOIN gg ON st.source IS NOT DISTINCT FROM gg.source){fills},
 c AS (SELECT *, CASE WHEN size > 0 THEN full_passes + fits::INT ELSE 0 END AS copies, least(1, (start + size / 2) / greatest(target, 1)) AS share FROM last)
SELECT doc_id, size, source_size, target, size * copies::BIGINT AS taken, copies::BIGINT AS copies, CASE WHEN copies > 0 THEN round({position("share")}, 9) END AS position FROM c"""


_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_UPPER}, {_LOWER})")} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM w),
 sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 edges AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
   HAVING 100 * count(*) >= {neardup.SIMILARITY} * (a.n + b.n - count(*))),
 sym AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
 comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN comp ON doc_id = a"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _urls(),
    "op2_quality_rules": _quality(),
    "op3_hamming_topk": _HAMMING,
    "op7_line_dedup": _lines(),
    "op8_mixing": _mixing(),
    "op10_minhash_near_dedup": _NEAR,
    "op13_prefix_trie": prefix_trie.SQL,
}
