"""The same queries as DuckDB SQL."""

from __future__ import annotations

from logweave.functions.patterns import DEFAULT_NAMES, REGEXES, PatternSet

EV = """ev AS (
  SELECT event_id AS line_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' user=' || user_id || ' ' || event_type || ' ' || printf('%.2f', value) || ' ' || props AS line
  FROM events)"""
PARTS = """ev AS (SELECT p_partkey AS line_id, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' ' || printf('%.2f', p_retailprice) AS line FROM part)"""
SUPPLIERS = """ev AS (SELECT s_suppkey AS line_id, s_name || ' ' || s_nationkey || ' ' || printf('%.2f', s_acctbal) AS line FROM supplier)"""
# Blanks are space and tab; the other printable characters, line breaks too, belong to words.
RE = {n: r.replace(r"\S", r"[!-~\n\r\x0b\x0c]").replace(r"\s", r"[ \t]") for n, r in REGEXES.items()}
EIGHT = DEFAULT_NAMES
FROM_J = "(SELECT line_id, line, unnest(range(length(line))) AS j FROM ev)"


def _all(names=EIGHT) -> str:
    parts = [
        f"SELECT line_id, '{n}' AS name, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM "
        f"(SELECT line_id, line, j, unnest(range(j + 1, j + 1 + length(regexp_extract(substr(line, j + 1), '^(?:{RE[n]})')))) AS k FROM {FROM_J}) WHERE regexp_full_match(line[j + 1:k], '{RE[n]}')"
        for n in names
    ]
    return "m AS (" + " UNION ALL ".join(parts) + ")"


def _largest(names=EIGHT) -> str:
    parts = [f"SELECT line_id, '{n}' AS name, j, j + length(regexp_extract(substr(line, j + 1), '^(?:{RE[n]})')) AS k FROM {FROM_J}" for n in names]
    return "f AS (" + " UNION ALL ".join(parts) + "), m AS (SELECT line_id, name, CAST(min(j) AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM f WHERE k > j GROUP BY line_id, name, k)"


REDUCE = """e AS (SELECT line_id, name, j, max(k) AS k FROM m GROUP BY ALL), r AS (SELECT line_id, name, min(j) AS j, k FROM e GROUP BY line_id, name, k)"""


def _arcs(lines: str, without: tuple[str, ...] = ()) -> str:
    kept = f"WHERE name NOT IN ({', '.join(repr(x) for x in without)})" if without else ""
    return f"""WITH RECURSIVE {lines}, {_largest()}, p AS MATERIALIZED (SELECT line_id, j, k, name FROM m {kept}),
v AS MATERIALIZED (SELECT line_id, j AS u FROM p UNION SELECT line_id, k FROM p UNION SELECT line_id, 0 FROM ev UNION SELECT line_id, length(line) FROM ev),
w AS (SELECT line_id, u, lead(u) OVER (PARTITION BY line_id ORDER BY u) AS nxt FROM v),
starts AS (SELECT DISTINCT line_id, j AS u, 1 AS leaves FROM p), ends AS (SELECT DISTINCT line_id, k AS nxt, 1 AS enters FROM p),
g AS MATERIALIZED (SELECT line_id, u AS j, nxt AS k, 'any' AS name FROM w LEFT JOIN starts USING (line_id, u) LEFT JOIN ends USING (line_id, nxt)
      WHERE nxt IS NOT NULL AND (leaves IS NULL OR enters IS NULL)),
a AS (SELECT p.line_id, p.j, p.k, p.name FROM p LEFT JOIN g ON g.line_id = p.line_id AND g.j = p.j WHERE p.name <> 'any' OR g.j IS NULL UNION ALL SELECT * FROM g)"""


def _arcs_by_flags(lines: str, without: tuple[str, ...] = ()) -> str:
    """The arcs alone: vertices with flags for arcs in and out, gaps from a window over them, and of two ``any`` arcs from one vertex the gap's."""
    kept = f"WHERE name NOT IN ({', '.join(repr(x) for x in without)})" if without else ""
    return f"""WITH {lines}, {_largest()}, p AS MATERIALIZED (SELECT line_id, j, k, name FROM m {kept}),
v AS (SELECT line_id, u, max(leaves) AS leaves, max(enters) AS enters FROM (SELECT line_id, j AS u, 1 AS leaves, 0 AS enters FROM p UNION ALL SELECT line_id, k, 0, 1 FROM p
      UNION ALL SELECT line_id, 0, 0, 0 FROM ev UNION ALL SELECT line_id, length(line), 0, 0 FROM ev) GROUP BY line_id, u),
w AS (SELECT line_id, u AS j, leaves, lead(u) OVER (PARTITION BY line_id ORDER BY u) AS k, lead(enters) OVER (PARTITION BY line_id ORDER BY u) AS enters FROM v),
a AS (SELECT line_id, j, arg_max(k, gap) AS k, name FROM (SELECT line_id, j, k, name, 0 AS gap FROM p UNION ALL SELECT line_id, j, k, 'any', 1 FROM w WHERE k IS NOT NULL AND (leaves = 0 OR enters = 0)) GROUP BY line_id, j, name)"""


#: How many words of each length a pattern accepts, by counting, and the densities that follow.
DENSITY = """n AS (SELECT unnest(range(30)) AS n),
digits AS (SELECT n, pow(10, n) AS ways FROM n WHERE n > 0),
whole AS (SELECT s.n + d.n AS n, sum(s.ways * d.ways) AS ways FROM (VALUES (0, 1), (1, 2)) s(n, ways), digits d GROUP BY ALL),
octet AS (SELECT * FROM (VALUES (1, 10), (2, 100), (3, 256)) o(n, ways)),
four AS (SELECT a.n + b.n + c.n + d.n + 3 AS n, sum(CAST(a.ways * b.ways AS DOUBLE) * c.ways * d.ways) AS ways FROM octet a, octet b, octet c, octet d GROUP BY ALL),
hexa AS (SELECT n, pow(22, n) AS ways FROM n WHERE n <= 4),
groups(colons, n, ways) AS (SELECT 0, n, ways FROM hexa UNION ALL SELECT colons + 1, n, sum(ways) FROM (SELECT g.colons, g.n + 1 + h.n AS n, g.ways * h.ways AS ways FROM groups g, hexa h WHERE g.n + 1 + h.n < 30) GROUP BY colons, n),
six AS (SELECT n, sum(ways) AS ways FROM groups WHERE colons >= 2 GROUP BY n),
w(name, n, ways) AS (
  SELECT name, n, pow(size, n) FROM (VALUES ('alnum', 62), ('any', 100), ('hexa', 22), ('letters', 52), ('spaces', 2), ('uint', 10), ('word', 98)) p(name, size), n WHERE n > 0
  UNION ALL SELECT 'bool', 1, 2 UNION ALL SELECT 'delimiter', n, 6 FROM n WHERE n > 0 UNION ALL SELECT 'int', n, ways FROM whole
  UNION ALL SELECT 'float', n, ways FROM whole UNION ALL SELECT 'float', i.n + 1 + d.n, i.ways * d.ways FROM whole i, digits d
  UNION ALL SELECT 'ipv4', n, ways FROM four UNION ALL SELECT 'net_ipv4', f.n + 1 + p.n, f.ways * p.ways FROM four f, (VALUES (1, 10), (2, 33)) p(n, ways)
  UNION ALL SELECT 'ipv6', n, ways FROM six UNION ALL SELECT 'net_ipv6', s.n + 1 + p.n, s.ways * p.ways FROM six s, (VALUES (1, 10), (2, 100), (3, 29)) p(n, ways)
  UNION ALL SELECT 'path', n + 1, pow(67, n) FROM n WHERE n > 0),
density AS (SELECT name, sum(ways / pow(200, n)) AS density FROM w WHERE n < 30 GROUP BY name)"""


def _densities(patterns: PatternSet) -> str:
    """The densities as a relation; ``density_all`` has them from counting."""
    return f"dens(name, density) AS (VALUES {', '.join(f'({n!r}, CAST({d!r} AS DOUBLE))' for n, d in sorted(patterns.densities().items()))})"


def _paths() -> str:
    """The cheapest path of each line: the least cost, then the fewest arcs, then the first names, settled by relaxation."""
    return f"""{_densities(PatternSet.default())}, arc AS MATERIALIZED (SELECT line_id, j, k, name, density FROM a JOIN dens USING (name)),
path(line_id, u, best) USING KEY (line_id, u) AS (
  SELECT line_id, 0, {{'cost': CAST(0 AS DOUBLE), 'n': 0, 'names': CAST([] AS VARCHAR[])}} FROM ev
  UNION SELECT line_id, u, min(new.best) FROM (
    SELECT p.line_id, k AS u, {{'cost': p.best.cost + density, 'n': p.best.n + 1, 'names': list_append(p.best.names, name)}} AS best FROM path p JOIN arc ON arc.line_id = p.line_id AND j = p.u) new
  LEFT JOIN recurring.path old USING (line_id, u) WHERE old.best IS NULL OR new.best < old.best GROUP BY line_id, u)"""


def _lcs(two: str) -> str:
    """``apart(s, t, common, n)``: LCS lengths and distances by the bit-parallel recurrence, a character of the second string at a time; for strings of up to 62 characters."""
    bits = "(1::UBIGINT << length({}))"
    return f"""mask AS MATERIALIZED (SELECT s, s[i:i] AS c, CAST(sum(1::UBIGINT << (i - 1)) AS UBIGINT) AS m FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT DISTINCT s FROM {two})) GROUP BY ALL),
lcs(s, t, i, v) AS (SELECT s, t, 0, {bits.format('s')} - 1 FROM {two} UNION ALL
  SELECT r.s, r.t, i + 1, ((v + (v & coalesce(m, 0::UBIGINT))) | (v - (v & coalesce(m, 0::UBIGINT)))) & ({bits.format('r.s')} - 1) FROM lcs r LEFT JOIN mask ON mask.s = r.s AND c = r.t[i + 1:i + 1] WHERE i < length(r.t)),
apart AS MATERIALIZED (SELECT s, t, length(s) - bit_count(v) AS common, length(t) - length(s) + 2 * bit_count(v) AS n FROM lcs WHERE i = length(t))"""


def _distances(pairs: str, limit: str = "direct") -> str:
    """``dist(x, y, d, norm)`` of the pairs of lines: least costs over pairs of vertices, settled by relaxation.

    Costs from ``limit`` on (of the summed lengths ``n``) are left out; ``direct`` is the cost of one ``any`` step, or else of deleting all, which no least cost is above.
    """
    return f"""{_densities(PatternSet.default())}, arc AS MATERIALIZED (SELECT a.line_id, j, k, name, line[j + 1:k] AS infix FROM a JOIN ev USING (line_id)),
q AS MATERIALIZED (SELECT x, y, length(e.line) + length(f.line) AS n, length(e.line) AS n1, length(f.line) AS n2 FROM ({pairs}) JOIN ev e ON e.line_id = x JOIN ev f ON f.line_id = y),
two AS MATERIALIZED (SELECT DISTINCT b.infix AS s, c.infix AS t FROM q JOIN arc b ON b.line_id = x JOIN arc c ON c.line_id = y AND c.name = b.name WHERE b.infix <> c.infix),
{_lcs("two")},
joint AS MATERIALIZED (SELECT x, y, b.j AS i1, c.j AS i2, b.k AS k1, c.k AS k2, min(density * coalesce(apart.n, 0)) AS w
  FROM q JOIN arc b ON b.line_id = x JOIN arc c ON c.line_id = y AND c.name = b.name JOIN dens ON dens.name = b.name LEFT JOIN apart ON s = b.infix AND t = c.infix GROUP BY ALL),
bound AS MATERIALIZED (SELECT q.x, q.y, n, n1, n2, min(coalesce(w, n)) + 1e-6 AS direct FROM q LEFT JOIN joint ON joint.x = q.x AND joint.y = q.y AND i1 = 0 AND i2 = 0 AND k1 = n1 AND k2 = n2 GROUP BY ALL),
step AS MATERIALIZED (SELECT DISTINCT line_id, j, k FROM arc),
cost(x, y, i1, i2, d) USING KEY (x, y, i1, i2) AS (SELECT x, y, 0, 0, CAST(0 AS DOUBLE) FROM bound UNION
  SELECT x, y, i1, i2, min(new.d) FROM (
    SELECT z.x, z.y, k1 AS i1, k2 AS i2, d + w AS d FROM cost z JOIN joint b ON b.x = z.x AND b.y = z.y AND b.i1 = z.i1 AND b.i2 = z.i2
    UNION ALL SELECT z.x, z.y, k, i2, d + (k - i1) FROM cost z JOIN step ON line_id = z.x AND j = i1
    UNION ALL SELECT z.x, z.y, i1, k, d + (k - i2) FROM cost z JOIN step ON line_id = z.y AND j = i2) new
  JOIN bound USING (x, y) LEFT JOIN recurring.cost old USING (x, y, i1, i2) WHERE new.d < coalesce(old.d, 1e300) AND new.d < least(direct, {limit}) GROUP BY x, y, i1, i2),
dist AS MATERIALIZED (SELECT x, y, d, d / n AS norm FROM cost JOIN bound USING (x, y) WHERE i1 = n1 AND i2 = n2)"""


def _leaders(lines: str, threshold: float) -> str:
    """``fold(line_id, leaders, cluster_id)``: one pass over ``lines`` with the list of leaders so far."""
    return f"""row_of AS MATERIALIZED (SELECT line_id, row_number() OVER (ORDER BY line_id) AS r FROM {lines}),
fold(r, line_id, leaders, cluster_id) AS (SELECT r, line_id, [line_id], line_id FROM row_of WHERE r = 1 UNION ALL
  SELECT r, line_id, CASE WHEN near IS NULL THEN list_append(leaders, line_id) ELSE leaders END, coalesce(near, line_id) FROM (
    SELECT o.r, o.line_id, f.leaders, (SELECT arg_min(x, (norm, x)) FROM dist WHERE y = o.line_id AND norm < {threshold} AND list_contains(f.leaders, x)) AS near FROM fold f JOIN row_of o ON o.r = f.r + 1))"""


SIGNED = """numbered AS (SELECT line_id, u, row_number() OVER (PARTITION BY line_id ORDER BY u) AS n FROM v),
signed AS (SELECT a.line_id, string_agg(s.n || '-' || name || '-' || t.n, ',' ORDER BY s.n, name) AS sig FROM a JOIN numbered s ON s.line_id = a.line_id AND s.u = j JOIN numbered t ON t.line_id = a.line_id AND t.u = k GROUP BY a.line_id)"""
NEXT = "SELECT line_id AS x, line_id + 1 AS y FROM ev WHERE line_id + 1 IN (SELECT line_id FROM ev)"
EARLIER = "SELECT b.line_id AS x, c.line_id AS y FROM ev b JOIN ev c ON b.line_id < c.line_id"


LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL)"""
STRIP = r"regexp_replace({}, '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g')"
RESULTS = """runs AS (SELECT event_type AS algo, 'log' || (user_id % 10) AS log, user_id AS run, max(value) AS value, CAST(count(*) AS DOUBLE) AS time FROM events GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY algo, log ORDER BY value DESC, run) = 1)"""
JUDGED = """j AS (SELECT event_id, concat_ws('/', event_type, CASE WHEN value < 20 THEN CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END) AS truth,
  CASE WHEN value < 40 THEN concat_ws('/', CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), CASE WHEN event_type = 'view' THEN 'v' END) END AS found FROM events)"""
COLOR = "printf('hsl(%d, 80%%, 40%%)', CAST(floor(360 * ({i} / {n})) AS BIGINT))"
def _judged(threshold: float) -> str:
    """Clusters of suppliers at a threshold against their nations."""
    return f"""SELECT CAST({threshold} AS DOUBLE) AS max_dist, metric, round(CAST(value AS DOUBLE), 9) AS value FROM (
{_arcs(SUPPLIERS)}, {_distances(EARLIER, f'{threshold} * n')}, {_leaders('ev', threshold)},
judged AS (SELECT s_nationkey AS truth, cluster_id AS found FROM fold JOIN supplier ON s_suppkey = line_id),
met AS (SELECT truth, found, count(*) AS n FROM judged GROUP BY ALL), by_truth AS (SELECT truth, sum(n) AS nt FROM met GROUP BY ALL), by_found AS (SELECT found, sum(n) AS nf FROM met GROUP BY ALL),
sums AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM met) AS pairs, (SELECT sum(n) * (sum(n) - 1) / 2 FROM met) AS total, (SELECT sum(nt * (nt - 1) / 2) FROM by_truth) AS s1, (SELECT sum(nf * (nf - 1) / 2) FROM by_found) AS s2)
SELECT 'parsing accuracy' AS metric, (SELECT coalesce(sum(n), 0) FROM met JOIN by_truth USING (truth) JOIN by_found USING (found) WHERE n = nt AND n = nf) / (SELECT count(*) FROM judged) AS value
UNION ALL SELECT 'adjusted rand index', CASE WHEN (s1 + s2) / 2 = s1 * s2 / total THEN 1 ELSE (pairs - s1 * s2 / total) / ((s1 + s2) / 2 - s1 * s2 / total) END FROM sums
UNION ALL SELECT 'clusters', (SELECT count(*) FROM by_found))"""


SUPPLIER_CLUSTERS = f"{_arcs(SUPPLIERS)}, {_distances(EARLIER, '0.009 * n')}, {_leaders('ev', 0.009)}"
COLOURED = f"""ranks AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id FROM fold)),
colours AS (SELECT cluster_id, i, {COLOR.format(i='i', n='n')} AS color FROM ranks),
coloured AS (SELECT line_id, line, '<font style=''color:' || color || '''>' || printf('%3d', line_id) || '</font>' AS row_html FROM ev JOIN fold USING (line_id) JOIN colours USING (cluster_id))"""


#: The types of events, and the densities of all patterns and of a word for each type.
TYPES = "types AS (SELECT DISTINCT event_type AS t FROM events)"
TYPED = "SELECT name, density FROM density UNION ALL SELECT 'is_' || t, pow(200, -length(t)) FROM types"


def oracle_sql() -> dict[str, str]:
    accept = " || ".join(f"CASE WHEN regexp_full_match(word, '{RE[n]}') THEN ',{n}' ELSE '' END" for n in sorted(RE))
    allowed = """s AS (SELECT line_id, j, k FROM m WHERE name = 'spaces'), x AS (SELECT line_id, k AS b FROM s UNION SELECT line_id, 0 FROM ev), y AS (SELECT line_id, j AS e FROM s UNION SELECT line_id, length(line) FROM ev)"""
    starts = "(SELECT line_id, line, b AS j, e AS k FROM ev JOIN x USING (line_id) JOIN y USING (line_id) WHERE e > b)"
    delimited = " UNION ALL ".join(f"SELECT line_id, '{n}' AS name, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM {starts} WHERE regexp_full_match(line[j + 1:k], '{RE[n]}')" for n in EIGHT if n != "spaces")
    named = lambda rows: ", ".join(f"('{n}', '{r}')" for n, r in rows)
    text = "string_agg(line[j + 1:k], '{}' ORDER BY j, k)"
    return {
        "lines_scan": f"WITH {LINES} SELECT doc_id, CAST(place AS INTEGER) AS place, line FROM l",
        "lines_strip": f"WITH {LINES} SELECT doc_id, CAST(place AS INTEGER) AS place, {STRIP.format('line')} AS line FROM l",
        "lines_dense": "SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM events",
        "lines_head": f"WITH {EV} SELECT * FROM ev WHERE line_id < 1000",
        "log_names": r"SELECT page_id, string_split(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '_2k')[1] AS log FROM pages",
        "template_parts": f"""SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split(replace(html, '"', '<*>'), '<*>'), lambda x: {STRIP.format('x')}), lambda x: regexp_matches(x, '[a-zA-Z]')), '|'), '') AS parts FROM pages""",
        "pattern_accepts": f"WITH {EV}, w AS (SELECT DISTINCT unnest(string_split(line, ' ')) AS word FROM ev) SELECT word, substr({accept}, 2) AS names FROM w",
        "density_runs": f"WITH RECURSIVE {DENSITY}, {TYPES} SELECT name, round(density, 9) AS density FROM (SELECT name, density FROM density WHERE name IN ('alnum', 'any', 'hexa', 'letters', 'spaces', 'uint', 'word') "
        "UNION ALL SELECT 'letters_of_' || t, (SELECT sum(pow(x, n)) FROM (SELECT unnest(range(1, 30)) AS n)) FROM (SELECT t, len(list_distinct(string_split(t, ''))) / 200 AS x FROM types))",
        "density_all": f"WITH RECURSIVE {DENSITY}, {TYPES}, own AS ({TYPED}) SELECT name, round(density, 9) AS density, round(log10(density), 9) AS magnitude FROM own",
        "density_order": f"WITH RECURSIVE {DENSITY}, {TYPES}, own AS ({TYPED}) SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS place, round(density, 9) AS density FROM own WHERE name IN {EIGHT} OR name LIKE 'is\\_%' ESCAPE '\\'",
        "pattern_collection": f"WITH {TYPES} SELECT * FROM (VALUES {named([(n, REGEXES[n]) for n in EIGHT if n != 'uint'] + [('small_letters', '[a-z]+'), ('uint', '[0-9]{1,9}')])}) p(name, regex) UNION ALL SELECT 'is_' || t, t FROM types",
        "mkconf": f"WITH {TYPES} SELECT CAST(0.6 AS DOUBLE) AS threshold, name, regex FROM (SELECT * FROM (VALUES {named(REGEXES.items())}) p(name, regex) UNION ALL SELECT 'is_' || t, t FROM types)",
        "match_all": f"WITH {PARTS}, {_all()} SELECT * FROM m",
        "match_largest": f"WITH {EV}, {_largest()} SELECT * FROM m",
        "match_reduced": f"WITH {PARTS}, {_all()}, {REDUCE} SELECT line_id, name, j, k FROM r",
        "match_greedy": f"WITH {EV}, {_all().replace('m AS (', 'q AS (', 1)}, m AS (SELECT line_id, name, min(j) AS j, k FROM q GROUP BY line_id, name, k), {REDUCE} SELECT line_id, name, j, k FROM r",
        "match_delimited": f"WITH {EV}, {_largest()}, {allowed} {delimited}",
        "match_table_function": f"WITH {PARTS}, {_largest()} SELECT * FROM m",
        "match_dict": f"WITH {EV}, {_largest()} SELECT line_id, name, {text.format('|')} AS texts FROM m JOIN ev USING (line_id) GROUP BY line_id, name",
        "match_string": f"WITH {EV}, {_largest(('float', 'spaces', 'word'))}, t AS (SELECT line_id, name, {text.replace('{}', chr(39) * 2 + ', ' + chr(39) * 2)} AS texts FROM m JOIN ev USING (line_id) GROUP BY line_id, name) "
        "SELECT line_id, string_agg(printf('%-5s', name) || ': [''' || texts || ''']', chr(10) ORDER BY name) AS report FROM t GROUP BY line_id",
        "automaton_arcs": f"{_arcs_by_flags(EV)} SELECT line_id, CAST(j AS INTEGER) AS src, CAST(k AS INTEGER) AS dst, name FROM a",
        "automaton_infix": f"{_arcs_by_flags(EV)} SELECT line_id, CAST(j AS INTEGER) AS src, CAST(k AS INTEGER) AS dst, name, line[j + 1:k] AS infix FROM a JOIN ev USING (line_id)",
        "automaton_filtered": f"{_arcs_by_flags(EV, ('spaces', 'hexa'))} SELECT line_id, CAST(j AS INTEGER) AS src, CAST(k AS INTEGER) AS dst, name FROM a",
        "automaton_delta": f"{_arcs_by_flags(EV)} SELECT a.line_id, name, CAST(j AS INTEGER) AS src, CAST(k AS INTEGER) AS dst FROM a JOIN ev USING (line_id) WHERE j = instr(line, 'user=') - 1",
        "automaton_counts": f"{_arcs(EV)}, nv AS (SELECT line_id, count(*) AS n FROM v GROUP BY line_id), na AS (SELECT line_id, count(*) AS n FROM a GROUP BY line_id) SELECT line_id, CAST(nv.n AS INTEGER) AS n_vertices, CAST(na.n AS INTEGER) AS n_arcs FROM nv JOIN na USING (line_id)",
        "automaton_slices": f"{_arcs(EV)}, {_paths()}, steps AS (SELECT line_id, line, best.names AS names FROM path JOIN ev USING (line_id) WHERE u = length(line)), "
        "walk(line_id, place, name, j, k) AS (SELECT s.line_id, 0, names[1], 0, a.k FROM steps s JOIN a ON a.line_id = s.line_id AND a.j = 0 AND a.name = names[1] "
        "UNION ALL SELECT w.line_id, w.place + 1, names[w.place + 2], w.k, a.k FROM walk w JOIN steps s ON s.line_id = w.line_id JOIN a ON a.line_id = w.line_id AND a.j = w.k AND a.name = names[w.place + 2]) "
        "SELECT line_id, CAST(place AS INTEGER) AS place, name, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, line[j + 1:k] AS text FROM walk JOIN ev USING (line_id)",
        "automaton_similar_groups": f"{_arcs(PARTS)}, nv AS (SELECT line_id, count(*) AS n FROM v GROUP BY line_id), na AS (SELECT line_id, count(*) AS n FROM a GROUP BY line_id), "
        "c AS MATERIALIZED (SELECT line_id, p_brand AS brand, nv.n AS v, na.n AS e, row_number() OVER (PARTITION BY p_brand ORDER BY line_id) AS r FROM nv JOIN na USING (line_id) JOIN part ON p_partkey = line_id), "
        "fold(brand, r, line_id, group_id, firsts) AS (SELECT brand, r, line_id, line_id, [{'i': line_id, 'v': v, 'e': e}] FROM c WHERE r = 1 UNION ALL "
        "SELECT brand, r, line_id, coalesce(near, line_id), CASE WHEN near IS NULL THEN list_append(firsts, {'i': line_id, 'v': v, 'e': e}) ELSE firsts END FROM ("
        "SELECT c.brand, c.r, c.line_id, c.v, c.e, f.firsts, list_filter(f.firsts, lambda x: abs(x.v - c.v) <= 1 AND abs(x.e - c.e) <= 2)[1].i AS near FROM fold f JOIN c ON c.brand = f.brand AND c.r = f.r + 1)) "
        "SELECT line_id, group_id FROM fold",
        "automaton_signature_groups": f"{_arcs(EV)}, {SIGNED} SELECT line_id, min(line_id) OVER (PARTITION BY sig) AS group_id FROM signed",
        "cheapest_path": f"{_arcs(EV)}, {_paths()} SELECT line_id, round(best.cost, 9) AS cost, array_to_string(best.names, ' ') AS path FROM path JOIN ev USING (line_id) WHERE u = length(line)",
        "pattern_distance": f"{_arcs(SUPPLIERS)}, {_distances(NEXT)} SELECT x AS line_id, round(d, 9) AS d FROM dist",
        "pattern_distance_normalized": f"{_arcs(EV)}, {_distances(NEXT)} SELECT x AS line_id, round(norm, 9) AS d, CASE WHEN norm < 0.05 THEN round(norm, 9) END AS d_below FROM dist",
        "pattern_distance_cutoff": f"{_arcs(EV)}, {_distances(NEXT, '0.05 * n')} SELECT x AS line_id, round(dist.norm, 9) AS d FROM ({NEXT}) LEFT JOIN dist USING (x, y)",
        "nearest_supplier": f"{_arcs(SUPPLIERS)}, lead AS (SELECT min(s_suppkey) AS x FROM supplier GROUP BY s_nationkey), {_distances('SELECT x, line_id AS y FROM ev, lead', '0.009 * n')}, "
        "best AS (SELECT y, min({'d': norm, 'x': x}) AS b FROM dist GROUP BY y) SELECT line_id, best.b.x AS leader, round(best.b.d, 9) AS d FROM ev LEFT JOIN best ON y = line_id",
        "cluster_suppliers": f"{SUPPLIER_CLUSTERS} SELECT line_id, cluster_id FROM fold",
        "cluster_suppliers_preprocessed": f"{_arcs(SUPPLIERS)}, {SIGNED}, firsts AS MATERIALIZED (SELECT sig, min(line_id) AS line_id FROM signed GROUP BY sig), "
        f"{_distances('SELECT b.line_id AS x, c.line_id AS y FROM firsts b JOIN firsts c ON b.line_id < c.line_id', '0.009 * n')}, {_leaders('firsts', 0.009)} SELECT signed.line_id, cluster_id FROM signed JOIN firsts USING (sig) JOIN fold ON fold.line_id = firsts.line_id",
        "lcs": f"WITH RECURSIVE {EV}, q AS (SELECT e.line_id, e.line AS s, f.line AS t FROM ev e JOIN ev f ON f.line_id = e.line_id + 1), two AS (SELECT DISTINCT s, t FROM q), {_lcs('two')} "
        "SELECT line_id, CAST(common AS INTEGER) AS lcs_length, CAST(n AS INTEGER) AS lcs_distance FROM q JOIN apart USING (s, t)",
        "template_match": f"WITH {EV}, t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS template_id FROM (SELECT DISTINCT event_type FROM events)) SELECT line_id, CAST(min(template_id) AS INTEGER) AS template_id FROM ev JOIN t ON contains(line, ' ' || event_type || ' ') GROUP BY line_id",
        "template_groups": "WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS template_id FROM (SELECT DISTINCT event_type FROM events)) SELECT CAST(template_id AS INTEGER) AS template_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS line_ids FROM events JOIN t USING (event_type) GROUP BY template_id",
        "template_integrity": f"WITH {EV} SELECT line_id, line FROM ev JOIN events ON line_id = event_id WHERE event_type = (SELECT min(event_type) FROM events)",
        "line_self_match": f"WITH {EV} SELECT line, line_id FROM ev",
        "parsing_accuracy": f"""WITH {JUDGED}, q AS (SELECT event_id, truth, CASE WHEN truth LIKE 'view%' THEN truth ELSE found END AS found FROM j),
n AS (SELECT truth, found, count(*) AS n FROM q WHERE found IS NOT NULL GROUP BY ALL), t AS (SELECT truth, count(*) AS nt FROM q GROUP BY ALL), f AS (SELECT found, sum(n) AS nf FROM n GROUP BY ALL)
SELECT round(coalesce(sum(n), 0) / (SELECT count(*) FROM q), 9) AS parsing_accuracy FROM n JOIN t USING (truth) JOIN f USING (found) WHERE n = nt AND n = nf""",
        "adjusted_rand_index": f"""WITH {JUDGED}, n AS (SELECT truth, coalesce(found, '') AS found, count(*) AS n FROM j GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n)AS pairs, (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS total,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM n GROUP BY truth)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM n GROUP BY found)) AS b)
SELECT round((pairs - a * b / total) / ((a + b) / 2 - a * b / total), 9) AS adjusted_rand_index FROM s""",
        "evaluation_grid": f"{_judged(0.004)} UNION ALL {_judged(0.009)}",
        "best_param": f"WITH {RESULTS} SELECT algo, log, value, time FROM best",
        "metric_projection": f"WITH {RESULTS} SELECT algo, log, time AS value FROM best",
        "log_order": f"WITH {RESULTS}, o AS (SELECT value, max(log) AS log FROM best WHERE algo = 'view' GROUP BY value) SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS place, log, value FROM o",
        "html_colors": f"WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey), e AS (SELECT s_nationkey, n, unnest(range(n)) AS i FROM c) SELECT s_nationkey, CAST(i AS INTEGER) AS i, {COLOR.format(i='i', n='n')} AS color FROM e",
        "values_to_colors": f"WITH c AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, CAST(i AS INTEGER) AS i, {COLOR.format(i='i', n='n')} AS color FROM c",
        "row_html": f"{SUPPLIER_CLUSTERS}, {COLOURED} SELECT line_id, row_html FROM coloured",
        "clustered_rows": f"{SUPPLIER_CLUSTERS}, {COLOURED} SELECT line_id, row_html || ': ' || line AS row FROM coloured",
        "lines_html": f"WITH {SUPPLIERS} SELECT '<pre>' || string_agg(printf('%3d', line_id) || ': ' || line, '<br/>' ORDER BY line_id) || '</pre>' AS html FROM ev WHERE line_id <> 3",
        "clustered_html": f"{SUPPLIER_CLUSTERS}, {COLOURED} SELECT (SELECT string_agg('<font style=''color:' || color || '''>Cluster ' || i || '</font>', '&nbsp;' ORDER BY i) FROM colours) || '<pre>' || string_agg(row_html || ': ' || line, '<br/>' ORDER BY line_id) || '</pre>' AS html FROM coloured",
        "result_json": f"{SUPPLIER_CLUSTERS} SELECT '[' || string_agg(cluster_id::VARCHAR, ',' ORDER BY line_id) || ']' AS json FROM fold",
    }
