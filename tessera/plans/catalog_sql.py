"""DuckDB SQL that says independently what the registered queries compute."""

from __future__ import annotations

M, K, WIDTH, CLUSTERS = 8, 16, 8, 8

RESULTS = "results AS (SELECT concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS smiles, CAST(l_suppkey % 16 AS INTEGER) AS cluster_id FROM lineitem)"
VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS fp FROM embeddings)"


def apart(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"




def first_words(k: int = K, m: int = M, width: int = WIDTH, order: str = "id") -> str:
    return f"""cb AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY {order}) - 1 AS c, list_slice(fp, s * {width} + 1, s * {width} + {width}) AS w
    FROM (SELECT * FROM v ORDER BY {order} LIMIT {k}), range({m}) r(s))"""


def codes(name: str, words: str, width: int = WIDTH) -> str:
    part = f"list_slice(v.fp, {words}.s * {width} + 1, {words}.s * {width} + {width})"
    return f"{name} AS (SELECT id, s, arg_min(c, (d, c)) AS code FROM (SELECT v.id, {words}.s, {words}.c, {apart(part, words + '.w')} AS d FROM v, {words}) GROUP BY id, s)"


def moved_words(name: str, words: str, enc: str, width: int = WIDTH) -> str:
    return f"""{name} AS (SELECT o.s, o.c, coalesce(n.w, o.w) AS w FROM {words} o LEFT JOIN (SELECT s, c, list(x ORDER BY d) AS w FROM
        (SELECT e.s, e.code AS c, d, CAST(floor(avg(v.fp[e.s * {width} + d])) AS BIGINT) AS x FROM {enc} e JOIN v USING (id), range(1, {width + 1}) r(d) GROUP BY ALL) GROUP BY s, c) n ON o.s = n.s AND o.c = n.c)"""


def distance_tables(words: str) -> str:
    return f"t AS (SELECT a.s, a.c AS c1, b.c AS c2, {apart('a.w', 'b.w')} AS d FROM {words} a JOIN {words} b USING (s))"


def first_centers(name: str = "z0", k: int = CLUSTERS, order: str = "id") -> str:
    return f"{name} AS (SELECT k, s, code FROM enc JOIN (SELECT id, row_number() OVER (ORDER BY {order}, id) - 1 AS k FROM v ORDER BY {order}, id LIMIT {k}) USING (id))"


WORDS, ENCODED, TABLES, FIRST = first_words(), codes("enc", "cb"), distance_tables("cb"), first_centers()


def labels(name: str, centers: str) -> str:
    return f"""{name} AS (SELECT id, arg_min(k, (d, k)) AS cluster_id, CAST(min(d) AS BIGINT) AS distance FROM (SELECT e.id, z.k, sum(t.d) AS d FROM enc e
        JOIN {centers} z ON e.s = z.s JOIN t ON t.s = e.s AND t.c1 = e.code AND t.c2 = z.code GROUP BY e.id, z.k) GROUP BY id)"""


def counted(name: str, of: str) -> str:
    return f"{name} AS (SELECT cluster_id, s, code, count(*) AS n FROM enc JOIN {of} USING (id) GROUP BY ALL)"


def moved(name: str, centers: str, histogram: str) -> str:
    return f"""{name} AS (SELECT z.k, z.s, coalesce(u.code, z.code) AS code FROM {centers} z LEFT JOIN (SELECT cluster_id, s, arg_min(c2, (cost, c2)) AS code FROM
        (SELECT h.cluster_id, h.s, t.c2, sum(h.n * t.d) AS cost FROM {histogram} h JOIN t ON t.s = h.s AND t.c1 = h.code GROUP BY ALL) GROUP BY cluster_id, s) u ON z.k = u.cluster_id AND z.s = u.s)"""


BASIS = [VECTORS, WORDS, ENCODED]
MODEL = [*BASIS, TABLES, FIRST, labels("asg", "z0")]


def two_steps(start: str, order: str = "id", k: int = CLUSTERS) -> list[str]:
    """CTEs of two moves of k centers; names begin with ``start``, the last centers are ``{start}2``."""
    z, a, h = (f"{start}{x}" for x in ("", "a", "h"))
    out = [first_centers(f"{z}0", k, order)]
    for n in (0, 1):
        out += [labels(f"{a}{n}", f"{z}{n}"), counted(f"{h}{n}", f"{a}{n}"), moved(f"{z}{n + 1}", f"{z}{n}", f"{h}{n}")]
    return out


def ask(ctes: list[str], select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


SMILES = "repeat('C', CAST(1 + p_size % 12 AS BIGINT)) || (CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'O' WHEN 2 THEN 'N' ELSE 'Cl' END)"
CHAIN = "chain AS (SELECT p_partkey, 1 + p_size % 12 AS c, 1 + p_size % 12 + CASE p_partkey % 4 WHEN 0 THEN 0 ELSE 1 END AS h, p_partkey % 4 AS g FROM part)"

#: All 42 counts of such a chain: those of atoms, bonds, polarity and topology that are not always 0.
_COUNTS = {0: "c", 2: "(g = 3)::INT", 7: "(g = 2)::INT", 9: "(g = 1)::INT", 11: "h", 12: "h - 1", 18: "greatest(h - 3, 0)", 19: "CASE g WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END", 20: "(g IN (1, 2))::INT",
           21: "CASE g WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END", 22: "(g IN (1, 2))::INT", 25: "CASE WHEN h > 1 THEN 2 ELSE 0 END", 26: "greatest(h - 2, 0)"}
MQN = f"list_transform([{', '.join(_COUNTS.get(k, '0') for k in range(42))}], lambda x: CAST(x AS BIGINT))"
MOLECULES = f"m AS (SELECT p.p_partkey AS id, {SMILES} AS smiles, {MQN} AS fp FROM part p JOIN chain USING (p_partkey))"


def molecule_clusters(order: str) -> str:
    """Two iterations of a codebook of 8 words for 6 subspaces, and of 4 centers, then every molecule's label."""
    ctes = [CHAIN, MOLECULES, "v AS (SELECT id, smiles, fp FROM m)", first_words(8, 6, 7, order), codes("e0", "cb", 7), moved_words("cb1", "cb", "e0", 7), codes("e1", "cb1", 7), moved_words("cb2", "cb1", "e1", 7)]
    ctes += [codes("enc", "cb2", 7), distance_tables("cb2"), *two_steps("z", order, 4), labels("asg", "z2")]
    return ask(ctes, "SELECT m.smiles, CAST(cluster_id AS INTEGER) AS cluster_id FROM asg JOIN m USING (id)")


def sweep(k: int) -> str:
    return f"""SELECT {k} AS k, CAST(sum(d) AS DOUBLE) AS inertia, round(sum(d) / sum(size), 6) AS avg_dist, CAST({k} - count(*) AS BIGINT) AS n_empty_clusters, round(100.0 * ({k} - count(*)) / {k}, 6)::DOUBLE AS pct_empty,
        round(avg(size), 6) AS cluster_size_mean, round(median(size), 6) AS cluster_size_median, round(stddev_pop(size), 6) AS cluster_size_std, min(size) AS cluster_size_min, max(size) AS cluster_size_max, CAST(sum(size) AS BIGINT) AS n_subsample
        FROM (SELECT cluster_id, count(*) AS size, sum(distance) AS d FROM asg{k} GROUP BY cluster_id)"""


#: Edges of the five nearest of each distinct molecule; one is in the forest if those before it do not join its ends.
FOREST = ask([CHAIN, MOLECULES, "u AS (SELECT min(id) AS id, any_value(fp) AS fp FROM m GROUP BY smiles)",
              f"""near AS (SELECT src, dst, d FROM (SELECT a.id AS src, b.id AS dst, {apart('a.fp', 'b.fp')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {apart('a.fp', 'b.fp')}, b.id) AS n FROM u a JOIN u b ON a.id <> b.id) WHERE n <= 5)""",
              "e AS (SELECT src, dst, d, row_number() OVER (ORDER BY d, src, dst) AS r FROM near)",
              "reach(r, src, dst, node) AS (SELECT r, src, dst, src FROM e UNION SELECT x.r, x.src, x.dst, CASE WHEN f.src = x.node THEN f.dst ELSE f.src END FROM reach x JOIN e f ON f.r < x.r AND (f.src = x.node OR f.dst = x.node))"],
             "SELECT src, dst, round(sqrt(d), 6) AS dist FROM e WHERE r NOT IN (SELECT r FROM reach WHERE node = dst)").replace("WITH ", "WITH RECURSIVE ", 1)

#: Distinct environments of up to two bonds of a chain's atoms, spelt out instead of hashed; of those of one step that
#: cover the same bonds one counts, and none whose bonds an earlier step covered.
MORGAN = ask([CHAIN, f"""a AS (SELECT smiles, h, i, CASE WHEN i > c THEN g::VARCHAR ELSE 'C' END || (CASE WHEN i > 1 THEN 1 ELSE 0 END + CASE WHEN i < h THEN 1 ELSE 0 END) AS e0
                  FROM (SELECT DISTINCT {SMILES} AS smiles, c, h, g FROM part JOIN chain USING (p_partkey)), range(1, 14) r(i) WHERE i <= h)""",
              *[f"""{'abc'[n]} AS (SELECT x.*, x.e{n - 1} || '(' || coalesce((SELECT string_agg(y.e{n - 1}, ',' ORDER BY y.e{n - 1}) FROM {'_ab'[n]} y WHERE y.smiles = x.smiles AND abs(y.i - x.i) = 1), '') || ')' AS e{n},
                  greatest(1, i - {n}) AS low{n}, least(h, i + {n}) AS high{n} FROM {'_ab'[n]} x)""" for n in (1, 2)]],
             """SELECT smiles, count(DISTINCT e0) + (SELECT count(DISTINCT e) FROM (SELECT min(e1) AS e FROM c y WHERE y.smiles = x.smiles GROUP BY low1, high1))
             + (SELECT count(DISTINCT e) FROM (SELECT min(e2) AS e FROM c y WHERE y.smiles = x.smiles AND NOT EXISTS (SELECT 1 FROM c z WHERE z.smiles = y.smiles AND z.low1 = y.low2 AND z.high1 = y.high2) GROUP BY low2, high2)) AS n_bits FROM c x GROUP BY smiles""")

ORACLES = {
    "morgan": MORGAN,
    "stream_assign": molecule_clusters("id"),
    "cluster_pipeline": molecule_clusters("md5('0|' || smiles), smiles"),
    "k_sweep": ask([*BASIS, TABLES, *two_steps("p", "id", 4), labels("asg4", "p2"), *two_steps("q", "id", 8), labels("asg8", "q2")], f"{sweep(4)} UNION ALL {sweep(8)}"),
    "tree_map": FOREST,
    "scan_sdf": f"SELECT {SMILES} AS smiles FROM part",
    "scan_npy": ask([VECTORS], "SELECT row_number() OVER (ORDER BY id) - 1 AS row, array_to_string(fp, ',') AS fp FROM v"),
    "scan_codes": ask(BASIS, "SELECT string_agg(code, ',' ORDER BY s) AS codes FROM enc GROUP BY id"),
    "model_io": ask(MODEL, "SELECT id, CAST(cluster_id AS INTEGER) AS cluster_id, distance FROM asg"),
    "results_folder": ask([RESULTS], "SELECT cluster_id, count(*) AS molecule_count FROM results GROUP BY cluster_id"),
    "query_cluster": ask([RESULTS], "SELECT smiles, cluster_id FROM results WHERE cluster_id = 3"),
    "query_batch": ask([RESULTS], "SELECT smiles, cluster_id FROM results WHERE cluster_id IN (1, 5, 9)"),
    "cluster_stats": ask([RESULTS], "SELECT cluster_id, count(*) AS molecule_count FROM results GROUP BY cluster_id"),
    "cluster_ids": ask([RESULTS], "SELECT DISTINCT cluster_id FROM results"),
    "total": ask([RESULTS], "SELECT count(*) AS total FROM results"),
    "top_clusters": ask([RESULTS], "SELECT cluster_id, count(*) AS molecule_count FROM results GROUP BY cluster_id ORDER BY molecule_count DESC, cluster_id LIMIT 5"),
    "largest_cluster": ask([RESULTS], "SELECT smiles, cluster_id FROM results WHERE cluster_id = (SELECT cluster_id FROM results GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1)"),
    "sample_cluster": ask([RESULTS], "SELECT smiles, cluster_id FROM results WHERE cluster_id = 3 ORDER BY md5('42|' || smiles), smiles LIMIT 100"),
    "representatives": ask([RESULTS], "SELECT cluster_id, arg_min(smiles, (md5('42|' || smiles), smiles)) AS smiles FROM results GROUP BY cluster_id"),
    "export_cluster": ask([RESULTS], "SELECT smiles, cluster_id FROM results WHERE cluster_id = 7"),
    "export_all": ask([RESULTS], "SELECT cluster_id, count(*) AS molecule_count FROM results GROUP BY cluster_id"),
    "scan_text": """SELECT token AS smiles FROM (SELECT list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')[2] AS token FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE token IS NOT NULL""",
    "chunk_ids": """SELECT doc_id, CAST((i - 1) // 3 AS BIGINT) AS chunk, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY ALL""",
    "train_head": ask([VECTORS], "SELECT id, array_to_string(fp, ',') AS fp FROM v ORDER BY id LIMIT 100"),
    "subsample": ask([VECTORS], "SELECT id, array_to_string(fp, ',') AS fp FROM v ORDER BY md5('7|' || id), id LIMIT 100"),
    "pq_split": ask([VECTORS], f"SELECT id, CAST(s AS INTEGER) AS sub, array_to_string(list_slice(fp, s * {WIDTH} + 1, s * {WIDTH} + {WIDTH}), ',') AS part FROM v, range({M}) r(s)"),
    "pq_encode": ask(BASIS, "SELECT id, string_agg(code, ',' ORDER BY s) AS codes FROM enc GROUP BY id"),
    "unique_codes": ask(BASIS, "SELECT count(DISTINCT codes) AS n_unique FROM (SELECT string_agg(code, ',' ORDER BY s) AS codes FROM enc GROUP BY id)"),
    "pq_decode": ask(BASIS, "SELECT id, string_agg(array_to_string(w, ','), ',' ORDER BY enc.s) AS decoded FROM enc JOIN cb ON enc.s = cb.s AND enc.code = cb.c GROUP BY id"),
    "pq_decode_binary": ask(BASIS, "SELECT id, string_agg(array_to_string(list_transform(w, lambda x: CASE WHEN x >= 0.6 THEN 1 ELSE 0 END), ','), ',' ORDER BY enc.s) AS decoded FROM enc JOIN cb ON enc.s = cb.s AND enc.code = cb.c GROUP BY id"),
    "recon_error": ask(BASIS, f"""SELECT round(e / n, 6) AS mse, round(sqrt(e / n), 6) AS rmse, round((1 - sqrt(e) / sqrt(x)) * 100, 6) AS fidelity FROM (SELECT CAST(sum({apart(f'list_slice(fp, enc.s * {WIDTH} + 1, enc.s * {WIDTH} + {WIDTH})', 'w')}) AS DOUBLE) AS e FROM enc JOIN cb ON enc.s = cb.s AND enc.code = cb.c JOIN v USING (id)),
        (SELECT CAST(sum(list_sum(list_transform(fp, lambda x: x * x))) AS DOUBLE) AS x, CAST(sum(len(fp)) AS DOUBLE) AS n FROM v)"""),
    "dist_tables": ask([*BASIS, TABLES], "SELECT CAST(s AS INTEGER) AS sub, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2, d FROM t"),
    "pq_assign": ask(MODEL, "SELECT id, CAST(cluster_id AS INTEGER) AS cluster_id FROM asg"),
    "pq_assign_distance": ask(MODEL, "SELECT id, CAST(cluster_id AS INTEGER) AS cluster_id, distance FROM asg"),
    "code_hist": ask([*MODEL, counted("h0", "asg")], "SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(s AS INTEGER) AS sub, CAST(code AS INTEGER) AS code, n FROM h0"),
    "pq_update": ask([*MODEL, counted("h0", "asg"), moved("z1", "z0", "h0")], "SELECT CAST(k AS INTEGER) AS cluster_id, CAST(s AS INTEGER) AS sub, CAST(code AS INTEGER) AS code FROM z1"),
    "pq_fit_codes_2iter": ask([*MODEL, counted("h0", "asg"), moved("z1", "z0", "h0"), labels("a1", "z1"), counted("h1", "a1"), moved("z2", "z1", "h1")], "SELECT CAST(k AS INTEGER) AS cluster_id, CAST(s AS INTEGER) AS sub, CAST(code AS INTEGER) AS code FROM z2"),
    "pq_fit_2iter": ask([*BASIS, moved_words("cb1", "cb", "enc"), codes("enc1", "cb1"), moved_words("cb2", "cb1", "enc1")], "SELECT CAST(s AS INTEGER) AS sub, CAST(c AS INTEGER) AS code, array_to_string(w, ',') AS centroid FROM cb2"),
    "avg_dist": ask(MODEL, "SELECT round(avg(distance), 6) AS avg_distance FROM asg"),
    "k_metrics": ask(MODEL, f"""SELECT {CLUSTERS} AS k, CAST(sum(d) AS BIGINT) AS inertia, round(sum(d) / sum(size), 6) AS avg_dist, CAST({CLUSTERS} - count(*) AS BIGINT) AS n_empty_clusters, round(100.0 * ({CLUSTERS} - count(*)) / {CLUSTERS}, 6)::DOUBLE AS pct_empty,
        round(avg(size), 6) AS cluster_size_mean, round(median(size), 6) AS cluster_size_median, round(stddev_pop(size), 6) AS cluster_size_std, min(size) AS cluster_size_min, max(size) AS cluster_size_max FROM (SELECT cluster_id, count(*) AS size, sum(distance) AS d FROM asg GROUP BY cluster_id)"""),
    "n_used": ask(MODEL, "SELECT count(DISTINCT cluster_id) AS n_used FROM asg"),
    "label_agreement": ask(MODEL, "SELECT count(*) AS compared, count(*) FILTER (asg.cluster_id <> e.label) AS mismatches FROM asg JOIN embeddings e ON asg.id = e.vec_id"),
    "knn_graph": ask([VECTORS], f"""SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(sqrt(d), 6) AS dist FROM (SELECT a.id AS src, b.id AS dst, {apart('a.fp', 'b.fp')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {apart('a.fp', 'b.fp')}, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= 5"""),
    "compression": "SELECT d, m, d * 4.0::DOUBLE / m AS ratio FROM (VALUES (42, 6), (1024, 8), (2048, 8), (64, 8), (30, 6), (20, 4)) x(d, m)",
    "mqn": ask([CHAIN, MOLECULES], "SELECT id AS p_partkey, array_to_string(fp, ',') AS fp FROM m"),
    "featurize_valid": "SELECT count(*) AS n_valid FROM part WHERE p_partkey % 5 <> 0",
    "mol_props": ask([CHAIN], "SELECT p_partkey, CAST(h AS DOUBLE) AS n_heavy_atoms, CAST((g IN (1, 2))::INT AS DOUBLE) AS hba, round(12.011 * c + CASE g WHEN 0 THEN 1.008 * (2 * c + 2) WHEN 1 THEN 15.999 + 1.008 * (2 * c + 2) WHEN 2 THEN 14.007 + 1.008 * (2 * c + 3) ELSE 35.45 + 1.008 * (2 * c + 1) END, 6)::DOUBLE AS mw FROM chain"),
}
