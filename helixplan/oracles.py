"""DuckDB SQL of the registered queries: the same results, computed another way."""

from __future__ import annotations

RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


def _seqs() -> str:
    return "seqs AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"


def _solid(k: int, least: int = 3) -> str:
    return f"""{_seqs()},
win AS (SELECT unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, i, {k}))) AS kmer FROM seqs WHERE length(seq) >= {k}),
counts AS (SELECT least(kmer, {RC.format("kmer")}) AS kmer, count(*) AS cnt FROM win GROUP BY 1),
solid AS (SELECT kmer, cnt FROM counts WHERE cnt >= {least}),
oriented AS MATERIALIZED (SELECT kmer FROM solid UNION SELECT {RC.format("kmer")} FROM solid)"""


def _halves(k: int) -> str:
    return f"""{_seqs()},
win AS (SELECT coalesce(seq_id % 2, 0) AS half, unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, i, {k}))) AS kmer FROM seqs WHERE length(seq) >= {k}),
halves AS (SELECT least(kmer, {RC.format("kmer")}) AS kmer, half, count(*) AS cnt FROM win GROUP BY 1, 2)"""


def _degrees(k: int) -> str:
    return f"""{_solid(k)},
outs AS (SELECT substr(kmer, 1, {k - 1}) AS o, count(*) AS n FROM oriented GROUP BY 1),
ins AS (SELECT substr(kmer, 2) AS o, count(*) AS n FROM oriented GROUP BY 1),
degrees AS MATERIALIZED (SELECT kmer, coalesce(i.n, 0) AS in_deg, coalesce(o.n, 0) AS out_deg,
  (coalesce(i.n, 0) <> 1 OR coalesce(o.n, 0) <> 1) AND (coalesce(i.n, 0) <> 0 OR coalesce(o.n, 0) <> 0) AS terminal
  FROM oriented LEFT JOIN outs o ON o.o = substr(kmer, 2) LEFT JOIN ins i ON i.o = substr(kmer, 1, {k - 1})),
nodes AS MATERIALIZED (SELECT kmer FROM degrees WHERE terminal)"""


def _edges(k: int) -> str:
    return f"""{_degrees(k)},
succ AS MATERIALIZED (SELECT a.kmer AS a, b.kmer AS b, b.terminal AS stop FROM degrees a JOIN degrees b ON substr(a.kmer, 2) = substr(b.kmer, 1, {k - 1})),
go(src, cur, seq, stop) AS (SELECT a, b, right(b, 1), stop FROM succ JOIN nodes ON a = kmer
  UNION ALL SELECT src, b, seq || right(b, 1), s.stop FROM go JOIN succ s ON s.a = go.cur WHERE NOT go.stop),
edges AS MATERIALIZED (SELECT src || ':' || left(seq, 1) AS edge_id, src, cur AS dst, seq FROM go WHERE stop)"""


def _components(k: int) -> str:
    return f"""{_edges(k)},
near AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
meets(a, b) AS (SELECT kmer, kmer FROM nodes UNION SELECT m.a, n.b FROM meets m JOIN near n ON m.b = n.a),
comps AS (SELECT a AS node_id, min(b) AS component FROM meets GROUP BY 1),
sizes AS (SELECT component, count(*) AS nodes, coalesce(sum(n), 0)::BIGINT AS total_len FROM comps LEFT JOIN (SELECT src, sum(length(seq)) AS n FROM edges GROUP BY 1) o ON o.src = node_id GROUP BY 1)"""


def _positions(k: int) -> str:
    return f"""{_edges(k)},
positions AS MATERIALIZED (SELECT substr(src || seq, d + 1, {k}) AS kmer, 'E' AS kind, edge_id AS id, d::INT AS dist FROM (SELECT *, unnest(range(1, length(seq))) AS d FROM edges)
  UNION ALL SELECT kmer, 'N', kmer, 0 FROM nodes)"""


def _pairs() -> str:
    return f"""frags AS (SELECT seq_id, seq, unnest(range(1, length(seq) - 250 + 2, 10)) AS spot FROM seqs WHERE length(seq) >= 250 AND seq_id IS NOT NULL),
pairs AS (SELECT seq_id * 4294967296 + spot AS pair_id, substr(seq, spot, 36) AS mate1, {RC.format("substr(seq, spot + 214, 36)")} AS mate2 FROM frags)"""


def _placed(k: int) -> str:
    return f"""{_positions(k)}, {_pairs()},
ends AS (SELECT pair_id, 1 AS orient, left(mate1, {k}) AS k1, {RC.format(f"left(mate2, {k})")} AS k2 FROM pairs WHERE length(mate1) >= {k} AND length(mate2) >= {k}
  UNION ALL SELECT pair_id, 2, left(mate2, {k}), {RC.format(f"left(mate1, {k})")} FROM pairs WHERE length(mate1) >= {k} AND length(mate2) >= {k}),
placed AS MATERIALIZED (SELECT pair_id, orient, p.kind AS kind1, p.id AS id1, p.dist AS dist1, q.kind AS kind2, q.id AS id2, q.dist AS dist2 FROM ends JOIN positions p ON p.kmer = k1 JOIN positions q ON q.kmer = k2),
clear AS MATERIALIZED (SELECT DISTINCT pair_id, orient FROM placed WHERE kind1 = 'E' AND kind2 = 'E' AND id1 = id2 AND dist2 - dist1 + {k} BETWEEN 180 AND 250)"""


def _walk(k: int) -> str:
    return f"""{_placed(k)},
users AS MATERIALIZED (SELECT pair_id, orient, concat_ws('|', kind1, id1, dist1, kind2, id2, dist2) AS tid, kind1, id1, dist1, kind2, id2, dist2 FROM placed WHERE (pair_id, orient) NOT IN (SELECT (pair_id, orient) FROM clear)),
ti AS MATERIALIZED (SELECT DISTINCT tid, CASE WHEN kind1 = 'E' THEN a.dst ELSE id1 END AS u, CASE WHEN kind1 = 'E' THEN length(a.seq) - dist1 ELSE 0 END AS du, a.edge_id AS e1,
  CASE WHEN kind2 = 'E' THEN b.src ELSE id2 END AS v, CASE WHEN kind2 = 'E' THEN dist2 ELSE 0 END AS dv, b.edge_id AS e2
  FROM users LEFT JOIN edges a ON kind1 = 'E' AND a.edge_id = id1 LEFT JOIN edges b ON kind2 = 'E' AND b.edge_id = id2),
fw(tid, node, dist, prev, dv) AS (SELECT tid, u, du, e1, dv FROM ti WHERE du + dv <= 250
  UNION SELECT tid, e.dst, fw.dist + length(e.seq), e.edge_id, dv FROM fw JOIN edges e ON e.src = fw.node WHERE fw.dist + length(e.seq) + dv <= 250),
fws AS MATERIALIZED (SELECT * FROM fw),
done AS MATERIALIZED (SELECT f.tid, f.node, f.dist, f.prev, t.e2 FROM fws f JOIN ti t USING (tid) WHERE f.node = t.v AND f.dist + t.dv BETWEEN 180 AND 250),
ok(tid, node, dist, prev) AS (SELECT tid, node, dist, prev FROM done
  UNION SELECT f.tid, f.node, f.dist, f.prev FROM ok JOIN edges e ON e.edge_id = ok.prev JOIN fws f ON f.tid = ok.tid AND f.node = e.src AND f.dist = ok.dist - length(e.seq)),
trans AS (SELECT DISTINCT ok.tid, f.prev AS e_in, ok.prev AS e_out FROM ok JOIN edges e ON e.edge_id = ok.prev JOIN fws f ON f.tid = ok.tid AND f.node = e.src AND f.dist = ok.dist - length(e.seq) WHERE f.prev IS NOT NULL
  UNION SELECT tid, prev, e2 FROM done WHERE prev IS NOT NULL AND e2 IS NOT NULL),
support AS MATERIALIZED (SELECT e_in, e_out, count(*) AS support FROM (SELECT DISTINCT pair_id, orient, e_in, e_out FROM users JOIN trans USING (tid)) GROUP BY 1, 2)"""


def _ports(k: int, cutoff: int) -> str:
    return f"""{_walk(k)},
through AS (SELECT dst AS node_id FROM edges INTERSECT SELECT src FROM edges),
ports AS (SELECT dst AS node_id, 'I' AS side, edge_id, 'I' || edge_id AS port FROM edges WHERE dst IN (FROM through) UNION ALL SELECT src, 'O', edge_id, 'O' || edge_id FROM edges WHERE src IN (FROM through)),
links AS (SELECT 'I' || e_in AS a, 'O' || e_out AS b FROM support s JOIN edges i ON i.edge_id = e_in JOIN edges o ON o.edge_id = e_out AND o.src = i.dst WHERE s.support >= {cutoff}),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
bound(a, b) AS (SELECT a, a FROM both_ways UNION SELECT m.a, w.b FROM bound m JOIN both_ways w ON m.b = w.a),
parts AS (SELECT a AS port, min(b) AS least FROM bound GROUP BY 1)"""


def _records() -> str:
    return f"""{_seqs()}, cut AS (SELECT seq_id, left(seq, 72) AS s FROM seqs WHERE seq_id IS NOT NULL AND length(seq) >= 72),
records AS (SELECT '@' || seq_id AS header, replace(s, 'GT', 'GN') AS bases, left(translate(s, 'ACGT', 'I5I#'), CASE WHEN seq_id % 3 = 0 THEN 50 ELSE 72 END) AS qual FROM cut)"""


def _mate(bases: str, qual: str, after: int = 10) -> str:
    """Bases up to the quality's end, to the first # after the first ten, and to the first N."""
    kept = f"CASE WHEN contains(substr({qual}, {after + 1}), '#') THEN {after} + strpos(substr({qual}, {after + 1}), '#') - 1 ELSE length({qual}) END"
    return f"split_part(left({bases}, {kept}), 'N', 1)"


def _sql(head: str, tail: str) -> str:
    return f"WITH RECURSIVE {head}\n{tail}"


def build(k: int, short_k: int, cutoff: int, contig_above: int, take_first: int, restore_depth: int) -> dict[str, str]:
    rc = RC.format
    code = "(strpos('AGCT', substr({0}, i + {1}, 1)) - 1) * {2}".format
    record = lambda m: f"printf('%02X', length({m})) || list_aggregate(list_transform(range(1, length({m}) + 1, 4), lambda i: printf('%02X', {' + '.join(f'CASE WHEN i + {j} <= length({m}) THEN {code(m, j, 4**j)} ELSE 0 END' for j in range(4))})), 'string_agg', '')"
    label = "CASE WHEN length(seq) <= 50 THEN seq ELSE length(seq)::VARCHAR END"
    hist = "hist AS (SELECT length(seq)::BIGINT AS len, count(*) AS cnt FROM edges GROUP BY 1), run AS (SELECT len, cnt, sum(len * cnt) OVER (ORDER BY len) AS upto, sum(cnt) OVER (ORDER BY len) AS n, sum(len * cnt) OVER () AS total, sum(cnt) OVER () AS rows FROM hist)"
    long = hist.replace("FROM edges", f"FROM edges WHERE length(seq) > {contig_above}")
    like = "5 * abs({0} - {1}) < greatest({0}, {1})".format
    return {
        "seq_revcomp": _sql(_seqs(), f"SELECT seq_id, translate(seq, 'ACGT', 'TGCA') AS complement, reverse(seq) AS reversed, {rc('seq')} AS revcomp FROM seqs"),
        "seq_canonical": _sql(_seqs(), f"SELECT seq_id, least(seq, {rc('seq')}) AS canonical FROM seqs"),
        "seq_slices": _sql(_seqs(), "SELECT seq_id, left(seq, 10) AS taken, substr(seq, 11) AS dropped, substr(seq, 6, 10) AS part, substr(seq, 1, 1) AS head, length(seq)::BIGINT AS len, 'A' || seq || 'T' AS grown FROM seqs"),
        "valid_prefix": "SELECT doc_id AS seq_id, regexp_extract(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '^[ACGT]*') AS prefix FROM documents",
        "mate_split": _sql(f"{_seqs()}, {_pairs()}", "SELECT pair_id, mate1, mate2 FROM pairs"),
        "kmer_windows": _sql(_seqs(), f"SELECT seq_id, i::INT AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM seqs WHERE length(seq) >= {k})"),
        "seq_pack": _sql(_solid(k), f"SELECT kmer, list_sum(list_transform(range(1, {k} + 1), lambda i: (strpos('AGCT', substr(kmer, i, 1)) - 1)::BIGINT << (2 * (i - 1))))::BIGINT AS packed, kmer AS unpacked FROM solid"),
        "kmer_count": _sql(_solid(short_k), "SELECT kmer, cnt FROM counts"),
        "kmer_solid": _sql(_solid(k), "SELECT kmer, cnt FROM solid"),
        "kmer_spectrum": _sql(_solid(short_k), "SELECT cnt, count(*) AS kmers FROM counts GROUP BY 1"),
        "kmer_distinct": _sql(_solid(k), "SELECT count(DISTINCT kmer) AS kmers FROM win"),
        "conversion_counters": _sql(f"{_seqs()}, {_pairs()}", f"SELECT count(*) AS pairs, sum(greatest(length(mate1) - {k - 1}, 0) + greatest(length(mate2) - {k - 1}, 0))::BIGINT AS kmers, count(*) FILTER (length(mate1) < {k} OR length(mate2) < {k}) AS short_pairs FROM pairs"),
        "kmer_degrees": _sql(_degrees(k), "SELECT kmer, in_deg, out_deg, terminal FROM degrees"),
        "graph_nodes": _sql(_degrees(k), "SELECT kmer FROM nodes"),
        "kmer_oriented": _sql(_solid(k), "SELECT kmer FROM oriented"),
        "kmer_successors": _sql(_solid(k), f"SELECT a.kmer, b.kmer AS next FROM oriented a JOIN oriented b ON right(a.kmer, {k - 1}) = left(b.kmer, {k - 1})"),
        "kmer_lookup": _sql(
            f"{_solid(k)}, target AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS g FROM benchmark), asked AS (SELECT DISTINCT unnest(list_transform(range(1, length(g) - {k} + 2), lambda i: substr(g, i, {k}))) AS kmer FROM target WHERE length(g) >= {k})",
            f"SELECT a.kmer, s.cnt FROM asked a LEFT JOIN solid s ON s.kmer = least(a.kmer, {rc('a.kmer')})",
        ),
        "pair_records": _sql(
            f"{_seqs()}, {_pairs()}, packed AS (SELECT pair_id, {record('mate1')} || {record('mate2')} AS record FROM pairs)",
            "SELECT pair_id, record FROM packed",
        ),
        "edge_ends": _sql(
            f"{_edges(k)}, outs2 AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), ins2 AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1)",
            "SELECT edge_id, src AS src_kmer, o.n AS src_out, dst AS dst_kmer, i.n AS dst_in FROM edges JOIN outs2 o USING (src) JOIN ins2 i USING (dst)",
        ),
        "edge_labels": _sql(_edges(k), f"SELECT edge_id, {label} AS label FROM edges"),
        "simplified_edges": _sql(
            f"""{_edges(k)}, cut AS MATERIALIZED (SELECT * FROM edges WHERE length(seq) > 1),
plain AS MATERIALIZED (SELECT n FROM (SELECT src AS n, 0 AS i, 1 AS o FROM cut UNION ALL SELECT dst, 1, 0 FROM cut) GROUP BY n HAVING sum(i) = 1 AND sum(o) = 1),
chain(edge_id, src, dst, seq) AS (SELECT edge_id, src, dst, seq FROM cut WHERE src NOT IN (FROM plain)
  UNION ALL SELECT c.edge_id, c.src, e.dst, c.seq || e.seq FROM chain c JOIN cut e ON e.src = c.dst WHERE c.dst IN (FROM plain))""",
            "SELECT edge_id, src, dst, seq FROM chain WHERE dst NOT IN (FROM plain)",
        ),
        "unexplained_pairs": _sql(_placed(k), "SELECT DISTINCT pair_id, orient FROM placed WHERE (pair_id, orient) NOT IN (SELECT (pair_id, orient) FROM clear)"),
        "graph_edges": _sql(_edges(k), "SELECT edge_id, src, dst, seq FROM edges"),
        "graph_counts": _sql(_edges(k), "SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, coalesce(sum(length(seq)), 0)::BIGINT AS total_len FROM edges"),
        "graph_adjacency": _sql(_edges(k), "SELECT kmer AS node_id, (SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM edges WHERE dst = kmer) AS in_edges, (SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM edges WHERE src = kmer) AS out_edges FROM nodes"),
        "edge_len_hist": _sql(f"{_edges(k)}, {hist}", "SELECT len, cnt FROM hist"),
        "n50": _sql(f"{_edges(k)}, {hist}", "SELECT len, cnt FROM run WHERE 2 * (upto - len * cnt) < total AND total <= 2 * upto"),
        "median_length": _sql(f"{_edges(k)}, {hist}", "SELECT len AS median_len FROM run WHERE n > rows // 2 AND n - cnt <= rows // 2"),
        "long_edge_count": _sql(f"{_edges(k)}, {hist}", "SELECT coalesce(sum(cnt), 0)::BIGINT AS cnt FROM hist WHERE len >= 100"),
        "contig_stats": _sql(f"{_edges(k)}, {long}", "SELECT coalesce(sum(cnt), 0)::BIGINT AS contigs, coalesce(sum(len * cnt), 0)::BIGINT AS total_len, max(len) AS max_len, (SELECT len FROM run WHERE n > rows // 2 AND n - cnt <= rows // 2) AS median_len, (SELECT len FROM run WHERE 2 * (upto - len * cnt) < total AND total <= 2 * upto) AS n50_weighted FROM hist"),
        "graph_components": _sql(_components(k), "SELECT node_id, component FROM comps"),
        "component_hist": _sql(_components(k), "SELECT nodes, count(*) AS components FROM sizes GROUP BY 1"),
        "component_len_hist": _sql(_components(k), "SELECT total_len, count(*) AS components FROM sizes GROUP BY 1"),
        "component_size_len_hist": _sql(_components(k), "SELECT nodes, total_len, count(*) AS components FROM sizes GROUP BY 1, 2"),
        "largest_component": _sql(_components(k), "SELECT component, nodes, total_len FROM sizes ORDER BY nodes DESC, component LIMIT 1"),
        "retained_edges": _sql(_components(k), "SELECT edge_id, src, dst, seq FROM edges JOIN comps ON node_id = src WHERE component = (SELECT component FROM sizes ORDER BY nodes DESC, component LIMIT 1)"),
        "kmer_positions": _sql(_positions(k), "SELECT kmer, kind, id, dist FROM positions"),
        "pair_positions": _sql(_placed(k), "SELECT pair_id, orient, kind1, id1, dist1, kind2, id2, dist2 FROM placed"),
        "explained_pairs": _sql(_placed(k), "SELECT pair_id, orient FROM clear"),
        "reach_min_dist": _sql(
            f"""{_edges(k)}, goals AS (SELECT src AS target FROM edges GROUP BY 1 HAVING count(*) > 1),
far(target, node, dist) AS (SELECT target, target, 0 FROM goals UNION SELECT f.target, e.src, f.dist + length(e.seq) FROM far f JOIN edges e ON e.dst = f.node WHERE f.dist + length(e.seq) <= 60)""",
            "SELECT target, node, min(dist)::BIGINT AS dist FROM far GROUP BY 1, 2",
        ),
        "pair_support": _sql(_walk(k), "SELECT e_in, e_out, support FROM support"),
        "bad_pairs": _sql(_walk(k), "SELECT (SELECT count(*) FROM clear) AS explained, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM (SELECT pair_id, orient, bool_or(tid IN (SELECT tid FROM done)) AS good FROM users GROUP BY 1, 2)"),
        "node_matrix": _sql(
            f"{_walk(k)}, cells AS (SELECT i.dst AS node_id, i.edge_id AS e_in, o.edge_id AS e_out, length(i.seq) AS il, length(o.seq) AS ol, coalesce(s.support, 0) AS s FROM edges i JOIN edges o ON o.src = i.dst LEFT JOIN support s ON s.e_in = i.edge_id AND s.e_out = o.edge_id)",
            """SELECT node_id || ' -> [' || string_agg(r, ', ' ORDER BY e_in) || '] [' || string_agg(il::VARCHAR, ', ' ORDER BY e_in) || '] ' || any_value(ols) AS line
FROM (SELECT node_id, e_in, il, '[' || string_agg(s::VARCHAR, ', ' ORDER BY e_out) || ']' AS r, '[' || string_agg(ol::VARCHAR, ', ' ORDER BY e_out) || ']' AS ols FROM cells GROUP BY 1, 2, 3) GROUP BY node_id""",
        ),
        "node_split": _sql(_ports(k, cutoff), "SELECT node_id, side, edge_id, node_id || '#' || substr(least, 2) AS clone FROM ports LEFT JOIN parts USING (port)"),
        "split_edges": _sql(
            f"{_ports(k, cutoff)}, named AS (SELECT node_id, side, edge_id, node_id || '#' || substr(least, 2) AS clone FROM ports LEFT JOIN parts USING (port))",
            "SELECT edge_id, coalesce(o.clone, e.src) AS src, coalesce(i.clone, e.dst) AS dst, seq FROM edges e LEFT JOIN (SELECT edge_id, clone FROM named WHERE side = 'O') o USING (edge_id) LEFT JOIN (SELECT edge_id, clone FROM named WHERE side = 'I') i USING (edge_id) WHERE edge_id NOT IN (SELECT edge_id FROM named WHERE clone IS NULL)",
        ),
        "resolved_edges": _sql(
            f"""{_ports(k, cutoff)}, named AS (SELECT node_id, side, edge_id, node_id || '#' || substr(least, 2) AS clone FROM ports LEFT JOIN parts USING (port)),
cut AS MATERIALIZED (SELECT edge_id, coalesce(o.clone, e.src) AS src, coalesce(i.clone, e.dst) AS dst, seq FROM edges e LEFT JOIN (SELECT edge_id, clone FROM named WHERE side = 'O') o USING (edge_id) LEFT JOIN (SELECT edge_id, clone FROM named WHERE side = 'I') i USING (edge_id) WHERE edge_id NOT IN (SELECT edge_id FROM named WHERE clone IS NULL)),
plain AS MATERIALIZED (SELECT n FROM (SELECT src AS n, 0 AS i, 1 AS o FROM cut UNION ALL SELECT dst, 1, 0 FROM cut) GROUP BY n HAVING sum(i) = 1 AND sum(o) = 1),
chain(edge_id, src, dst, seq) AS (SELECT edge_id, src, dst, seq FROM cut WHERE src NOT IN (FROM plain)
  UNION ALL SELECT c.edge_id, c.src, e.dst, c.seq || e.seq FROM chain c JOIN cut e ON e.src = c.dst WHERE c.dst IN (FROM plain))""",
            "SELECT edge_id, src, dst, seq FROM chain WHERE dst NOT IN (FROM plain)",
        ),
        "bubbles": _sql(
            f"{_edges(k)}, par AS (SELECT src, dst, list(edge_id ORDER BY strpos('AGCT', left(seq, 1))) AS id, list(length(seq) ORDER BY strpos('AGCT', left(seq, 1))) AS l FROM edges GROUP BY 1, 2 HAVING count(*) > 1), two AS (SELECT *, {like('l[1]', 'l[2]')} AS d2 FROM par), three AS (SELECT *, {like('l[1]', 'l[3]')} OR (NOT d2 AND {like('l[2]', 'l[3]')}) AS d3 FROM two), four AS (SELECT *, {like('l[1]', 'l[4]')} OR (NOT d2 AND {like('l[2]', 'l[4]')}) OR (NOT d3 AND {like('l[3]', 'l[4]')}) AS d4 FROM three)",
            "SELECT id[2] AS edge_id FROM four WHERE d2 UNION ALL SELECT id[3] FROM four WHERE d3 UNION ALL SELECT id[4] FROM four WHERE d4",
        ),
        "reference_missing_kmers": _sql(
            f"{_positions(k)}, target AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS g FROM benchmark)",
            f"SELECT DISTINCT kmer FROM (SELECT unnest(list_transform(range(1, length(g) - {k} + 2), lambda i: substr(g, i, {k}))) AS kmer FROM target WHERE length(g) >= {k}) WHERE kmer NOT IN (SELECT kmer FROM positions)",
        ),
        "dot_lines": _sql(_edges(k), f"""SELECT '"' || src || '" -> "' || dst || '" [label="' || {label} || '"]' AS line FROM edges"""),
        "fasta_lines": _sql(_edges(k), "SELECT n, '>contig' || n AS header, seq FROM (SELECT row_number() OVER (ORDER BY length(seq) DESC, seq, edge_id) AS n, seq FROM edges)"),
        "graph_neighbours": _sql(
            f"""{_edges(k)}, near AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), root AS (SELECT src AS r FROM edges GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1),
hops(n, hop) AS (SELECT r, 0 FROM root UNION SELECT b, hop + 1 FROM hops JOIN near ON a = n WHERE hop < 20), best AS (SELECT n, min(hop) AS hop FROM hops GROUP BY 1)""",
            "SELECT n AS node_id, hop::INT AS hop FROM best ORDER BY hop, n LIMIT 20",
        ),
        "fastq_records": _sql(_records(), "SELECT header, bases, qual FROM records"),
        "fastq_mates": _sql(
            f"""{_records()}, halves AS (SELECT header, left(bases, 36) AS b1, left(qual, 36) AS q1, substr(bases, 37) AS b2, substr(qual, 37) AS q2 FROM records)""",
            f"SELECT header, {_mate('b1', 'q1')} AS mate1, {_mate('b2', 'q2')} AS mate2 FROM halves",
        ),
        "packed_pairs_read": _sql(f"{_seqs()}, {_pairs()}", "SELECT (pair_id // 4294967296)::BIGINT::VARCHAR AS path, row_number() OVER (PARTITION BY pair_id // 4294967296 ORDER BY pair_id) - 1 AS place, mate1, mate2 FROM pairs"),
        "restored_kmers": _sql(
            f"""{_solid(k)},
rare AS MATERIALIZED (SELECT kmer FROM counts WHERE cnt < 3 UNION SELECT {rc('kmer')} FROM counts WHERE cnt < 3),
ahead(kmer, far) AS (SELECT r.kmer, 1 FROM rare r JOIN oriented s ON left(r.kmer, {k - 1}) = right(s.kmer, {k - 1})
  UNION SELECT r.kmer, far + 1 FROM ahead a JOIN rare r ON left(r.kmer, {k - 1}) = right(a.kmer, {k - 1}) WHERE far + 1 < {restore_depth}),
least_far AS (SELECT kmer, min(far) AS far FROM ahead GROUP BY 1),
ways AS (SELECT least(a.kmer, b.kmer) AS kmer, min(a.far + b.far) AS steps FROM least_far a JOIN least_far b ON b.kmer = {rc('a.kmer')} WHERE a.far + b.far <= {restore_depth} GROUP BY 1)""",
            "SELECT kmer, cnt, steps FROM ways JOIN counts USING (kmer)",
        ),
        "counted_write": _sql(f"{_seqs()}, {_pairs()}", f"SELECT count(*) AS stored, count(*) AS pairs, coalesce(sum(greatest(length(mate1) - {k - 1}, 0) + greatest(length(mate2) - {k - 1}, 0)), 0)::BIGINT AS kmers, count(*) FILTER (length(mate1) < {k} OR length(mate2) < {k}) AS short_pairs FROM pairs"),
        "broken_graph": _sql(
            f"""{_edges(k)}, bad AS (SELECT edge_id, src, dst, CASE WHEN length(seq) >= 2 THEN left(seq, length(seq) - 1) || translate(right(seq, 1), 'ACGT', 'TGCA') ELSE seq END AS seq FROM edges),
kept AS (SELECT DISTINCT src AS n FROM edges)""",
            f"SELECT edge_id, 'end without node' AS fault FROM bad WHERE dst NOT IN (FROM kept) UNION ALL SELECT edge_id, 'wrong end' FROM bad WHERE dst IN (FROM kept) AND right(src || seq, {k}) <> dst",
        ),
        "loaded_params": _sql(_solid(13, 2), "SELECT cnt, count(*) AS kmers FROM solid GROUP BY 1"),
        "fasta_kmers": _sql(_solid(k), "SELECT kmer, cnt FROM counts"),
        "store_merge": _sql(_solid(short_k), "SELECT kmer, cnt FROM counts"),
        "store_overwrite": _sql(_halves(short_k), "SELECT coalesce(b.kmer, a.kmer) AS kmer, coalesce(b.cnt, a.cnt) AS cnt FROM (FROM halves WHERE half = 0) a FULL JOIN (FROM halves WHERE half = 1) b ON a.kmer = b.kmer"),
        "store_insert": _sql(_halves(short_k), "SELECT kmer, cnt FROM halves"),
        "packed_files": _sql(f"{_seqs()}, {_pairs()}", "SELECT row_number() OVER (ORDER BY pair_id) - 1 AS place, mate1, mate2 FROM pairs"),
        "pair_meta": _sql(f"{_seqs()}, {_pairs()}", "SELECT count(*) AS pairs, 200 AS insert_len, min(pair_id) AS first_id, max(pair_id) AS last_id FROM pairs"),
        "fasta_read": "SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark",
        "fasta_lines_read": _sql(_edges(k), "SELECT seq AS value FROM edges"),
        "graph_read": _sql(
            f"{_edges(k)}, outs2 AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), ins2 AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1)",
            "SELECT edge_id, src AS src_kmer, o.n AS src_out, dst AS dst_kmer, i.n AS dst_in FROM edges JOIN outs2 o USING (src) JOIN ins2 i USING (dst)",
        ),
        "histogram_read": _sql(f"{_edges(k)}, {hist}", "SELECT len, cnt FROM hist"),
        "first_pair_positions": _sql(_placed(k), f"SELECT pair_id, orient, kind1, id1, dist1, kind2, id2, dist2 FROM placed WHERE pair_id < {take_first}"),
        "edited_edges": _sql(_edges(k), "SELECT edge_id, src, CASE WHEN length(seq) = 1 THEN 'extra' ELSE dst END AS dst, seq FROM edges UNION ALL SELECT 'extra:A', 'extra', 'extra', 'ACGT'"),
        "edited_nodes": _sql(_edges(k), f"SELECT kmer AS node_id, kmer FROM nodes WHERE kmer IN (SELECT src FROM edges) UNION ALL SELECT 'extra', repeat('A', {k})"),
        "sql_functions": _sql(
            f"{_seqs()}, cut AS (SELECT seq_id, i::INT AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM seqs WHERE length(seq) >= {k}))",
            f"SELECT seq_id, pos, kmer, {rc('kmer')} AS back, least(kmer, {rc('kmer')}) AS least, kmer AS prefix FROM cut",
        ),
        "invariants": "SELECT NULL::VARCHAR AS edge_id, NULL::VARCHAR AS fault WHERE false",
    }
