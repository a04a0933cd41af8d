"""The registered queries in DuckDB's SQL, written from their definitions and not from the plans."""

from __future__ import annotations

_PI2 = "2 * pi()"

#: Common table expressions, each with those that it needs.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "emb": ((), "SELECT vec_id AS id, label AS shard_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"),
    "unit": (("emb",), "SELECT id, shard_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS v FROM emb"),
    "asked": (("unit",), "SELECT id AS query_id, v AS q FROM unit WHERE id % 20 = 0"),
    "elements": (("unit",), "SELECT id, shard_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM unit"),
    "means": (("elements",), "SELECT shard_id, i, avg(x) AS m FROM elements GROUP BY shard_id, i"),
    "sizes": (("unit",), "SELECT shard_id, count(*) AS item_count FROM unit GROUP BY shard_id"),
    "lengths": (("means",), "SELECT shard_id, sqrt(sum(m * m)) AS len FROM means GROUP BY shard_id"),
    "cents": (("means", "lengths"), "SELECT m.shard_id, m.i, m.m / l.len AS v FROM means m JOIN lengths l USING (shard_id)"),
    "centers": (("cents",), "SELECT shard_id, list(v ORDER BY i) AS c FROM cents GROUP BY shard_id"),
    "gaps": (("unit", "centers"), "SELECT u.shard_id, max(list_distance(u.v, c.c)) AS radius, max(acos(greatest(-1, least(1, list_dot_product(u.v, c.c))))) AS angle FROM unit u JOIN centers c USING (shard_id) GROUP BY u.shard_id"),
    "scored": (("unit", "asked"), "SELECT query_id, id, shard_id, round(list_dot_product(q, v), 6) + 0.0 AS score FROM asked CROSS JOIN unit"),
    "topk": (("scored",), "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score, shard_id FROM scored) WHERE rank <= 10"),
    "shard_scores": (("asked", "centers"), "SELECT query_id, shard_id, round(list_dot_product(q, c), 6) + 0.0 AS score FROM asked CROSS JOIN centers"),
    "shard_places": (("shard_scores",), "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard_id) AS place FROM shard_scores"),
    "routed": (("shard_places",), "SELECT query_id, CAST(place AS INTEGER) AS rank, shard_id, score FROM shard_places WHERE place <= 3"),
    "routed_top": (
        ("scored", "routed"),
        "SELECT * FROM (SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id, s.score FROM scored s JOIN routed r ON s.query_id = r.query_id AND s.shard_id = r.shard_id) WHERE rank <= 10",
    ),
    "products": (
        (),
        "SELECT p_partkey AS id, p_name AS title, p_brand AS brand, p_type AS category, p_retailprice AS price_ron, p_size % 13 <> 0 AS in_stock FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)",
    ),
    "matching": (("products",), "SELECT id FROM products WHERE price_ron >= 905 AND price_ron <= 990 AND in_stock"),
    "spec": (
        ("cents",),
        f"SELECT k, i, sum(v * cos({_PI2} * k * shard_id / n)) AS re, -sum(v * sin({_PI2} * k * shard_id / n)) AS im FROM cents CROSS JOIN (SELECT count(DISTINCT shard_id) AS n FROM cents) CROSS JOIN range(6) t(k) GROUP BY k, i",
    ),
    "rebuilt": (
        ("spec",),
        f"SELECT band, n, i, sum(CASE WHEN k IN (0, 5) THEN 1 ELSE 2 END * (re * cos({_PI2} * k * n / 10.0) - im * sin({_PI2} * k * n / 10.0)) / 10.0) AS value "
        "FROM spec CROSS JOIN (VALUES (1), (2), (5)) b(band) CROSS JOIN range(10) t(n) WHERE k <= band GROUP BY band, n, i",
    ),
    "resid": (("rebuilt", "cents"), "SELECT band, n, sqrt(sum((v - value) ** 2)) AS residual FROM rebuilt JOIN cents ON n = shard_id AND rebuilt.i = cents.i GROUP BY band, n"),
    "asked_long": (("asked",), "SELECT query_id, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS i FROM asked"),
    "approx": (("rebuilt", "asked_long"), "SELECT query_id, band, n, sum(value * x) AS score FROM rebuilt JOIN asked_long USING (i) GROUP BY query_id, band, n"),
    "ivals": (("approx", "resid"), "SELECT query_id, band, n, score, score - residual AS lower, score + residual AS upper FROM approx JOIN resid USING (band, n)"),
    "cert": (
        ("ivals",),
        "SELECT query_id, band, string_agg(n, ',' ORDER BY n) FILTER (place <= 3) AS shards, min(lower) FILTER (place <= 3) - max(upper) FILTER (place > 3) AS margin "
        "FROM (SELECT *, row_number() OVER (PARTITION BY query_id, band ORDER BY round(score, 9) DESC, n) AS place FROM ivals) GROUP BY query_id, band",
    ),
    "measured": (("asked", "centers", "gaps"), "SELECT query_id, shard_id, list_dot_product(q, c) AS score, list_distance(q, c) AS distance, radius, angle FROM asked CROSS JOIN centers JOIN gaps USING (shard_id)"),
    "raw": (
        (),
        "SELECT p_partkey + 2 AS line_number, p_partkey AS key, CAST(round(p_retailprice * 100) AS BIGINT) // 100 || '.' || lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS price, * FROM part",
    ),
    "parsed": (
        ("raw",),
        "SELECT line_number, CASE WHEN key % 29 = 0 THEN NULL WHEN key % 11 = 0 AND key > 0 THEN 'P' || (key - 1) ELSE 'P' || key END AS product_id, CASE WHEN key % 31 = 0 THEN NULL ELSE p_name END AS title, "
        "p_type || ' ' || p_brand AS description, CASE WHEN key % 7 = 0 THEN NULL ELSE p_type END AS category, p_brand AS brand, "
        "key % 13 = 0 OR key % 17 = 0 OR (key % 19 <> 0 AND key % 23 = 0) AS bad_price, CASE WHEN key % 13 <> 0 AND key % 17 <> 0 AND key % 19 <> 0 AND (key % 23 = 0 OR key % 37 = 0) THEN NULL ELSE CAST(price AS DOUBLE) END AS price_ron, "
        "CASE WHEN key % 2 = 0 THEN 'unisex' END AS audience, key % 41 = 0 AS bad_stock, key % 5 IN (0, 1, 3) AS in_stock FROM raw",
    ),
    "firsts": (("parsed",), "SELECT product_id, min(line_number) AS first_line FROM parsed WHERE product_id IS NOT NULL AND title IS NOT NULL AND NOT bad_price AND NOT bad_stock GROUP BY product_id"),
    "judged": (
        ("parsed", "firsts"),
        "SELECT p.*, CASE WHEN p.product_id IS NULL THEN 'product_id is empty' WHEN title IS NULL THEN 'title is empty' WHEN line_number > first_line THEN 'duplicate product_id' WHEN bad_price THEN 'price_ron is invalid' "
        "WHEN bad_stock THEN 'in_stock is invalid' END AS error FROM parsed p LEFT JOIN firsts f ON p.product_id = f.product_id",
    ),
    "words": ((), "SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark"),
    "singles": (("words",), "SELECT item_id, unnest(t) AS w FROM words"),
    "numbers": ((), "SELECT range AS id, range % 256 + 1 AS category_id, ((range * 1103515245 + 42 * 12345 + (range % 256 + 1) * 2654435761) & 4294967295) AS mixed, range // 256 + 1 AS sequence FROM range((SELECT count(*) FROM part))"),
    "made": (
        ("numbers",),
        "SELECT 'P' || lpad(CAST(id + 1 AS VARCHAR), 7, '0') AS product_id, category_id, dep || ' > ' || dep || ' ' || ran AS category, dep || ' ' || ran AS sub, sequence, stem || ' ' || chr(CAST(65 + mixed % 8 AS INTEGER)) AS brand, "
        "['Start', 'Plus', 'Max', 'Pro', 'Ultra', 'Neo', 'Air', 'Eco'][(mixed >> 4) % 8 + 1] AS series, ['negru', 'alb', 'gri', 'roșu', 'albastru', 'verde', 'galben', 'maro', 'bej', 'mov', 'portocaliu', 'argintiu'][(mixed >> 8) % 12 + 1] AS color, "
        "['unisex', 'femei', 'bărbați', 'copii', 'familie'][(mixed >> 12) % 5 + 1] AS audience, (mixed + category_id) % 13 <> 0 AS in_stock, round(d * 5.0 + d * 495.0 * pow((mixed % 10000) / 9999.0, 1.35), 2) AS price_ron, "
        "['baterie de durată', 'materiale reciclate', 'montare ușoară', 'garanție extinsă', 'consum redus', 'design compact', 'protecție la apă', 'reglaj fin'] AS f, "
        "['uz zilnic', 'birou', 'călătorii', 'sport', 'casă', 'grădină', 'școală', 'cadouri'][(mixed >> 25) % 8 + 1] AS use, mixed FROM (SELECT *, CAST((category_id - 1) // 16 + 1 AS INTEGER) AS d, "
        "['Telefonie', 'Calculatoare', 'Sunet', 'Imagine', 'Electrocasnice', 'Mobilier', 'Bucătărie', 'Curte', 'Mișcare', 'Haine', 'Pantofi', 'Jocuri', 'Cărți', 'Mașini', 'Igienă', 'Papetărie'][(category_id - 1) // 16 + 1] AS dep, "
        "['Vox', 'Byt', 'Son', 'Lum', 'Cas', 'Lem', 'Gus', 'Ver', 'Vel', 'Tex', 'Pas', 'Jov', 'Pag', 'Mot', 'Pur', 'Scr'][(category_id - 1) // 16 + 1] AS stem, "
        "['de bază', 'compacte', 'premium', 'pentru copii', 'profesionale', 'de exterior', 'de drum', 'portabile', 'clasice', 'moderne', 'la set', 'cu accesorii', 'de rezervă', 'de sezon', 'noi', 'ecologice'][(category_id - 1) % 16 + 1] AS ran FROM numbers)",
    ),
    # 64 centroids on a curve, 40 queries between them
    "curve": (
        (),
        "SELECT n, i - 1 AS i, p[i] / sqrt(list_dot_product(p, p)) AS v FROM (SELECT n, [cos(t), sin(t), 0.5 * cos(2 * t), 0.5 * sin(2 * t), 0.02 * cos(9 * t), 0.02 * sin(9 * t)] AS p FROM (SELECT n, 2 * pi() * n / 64 AS t FROM range(64) r(n))) CROSS JOIN range(1, 7) x(i)",
    ),
    "curve_asked": (
        (),
        "SELECT j, i - 1 AS i, p[i] / sqrt(list_dot_product(p, p)) AS x FROM (SELECT j, [cos(u), sin(u), 0.5 * cos(2 * u), 0.5 * sin(2 * u), 0.0, 0.0] AS p FROM (SELECT j, 2 * pi() * (1.6 * j + 0.3) / 64 AS u FROM range(40) r(j))) CROSS JOIN range(1, 7) x(i)",
    ),
    "curve_spec": (("curve",), "SELECT k, i, sum(v * cos(2 * pi() * k * n / 64)) AS re, -sum(v * sin(2 * pi() * k * n / 64)) AS im FROM curve CROSS JOIN range(33) t(k) GROUP BY k, i"),
    "curve_rebuilt": (
        ("curve_spec",),
        "SELECT band, n, i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)) / 64) AS value FROM curve_spec CROSS JOIN (VALUES (1), (2), (4), (16)) b(band) CROSS JOIN range(64) t(n) WHERE k <= band GROUP BY band, n, i",
    ),
    "curve_resid": (("curve_rebuilt", "curve"), "SELECT band, n, sqrt(sum((v - value) ** 2)) AS residual FROM curve_rebuilt JOIN curve USING (n, i) GROUP BY band, n"),
    "curve_ivals": (
        ("curve_rebuilt", "curve_asked", "curve_resid"),
        "SELECT j, band, n, score, score - residual AS lower, score + residual AS upper FROM (SELECT j, band, n, sum(value * x) AS score FROM curve_rebuilt JOIN curve_asked USING (i) GROUP BY j, band, n) JOIN curve_resid USING (band, n)",
    ),
    "curve_cert": (
        ("curve_ivals",),
        "SELECT j, band, string_agg(n, ',' ORDER BY n) FILTER (place <= 8) AS shards, min(lower) FILTER (place <= 8) - max(upper) FILTER (place > 8) >= 1e-9 AS certified FROM (SELECT *, row_number() OVER (PARTITION BY j, band ORDER BY round(score, 9) DESC, n) AS place FROM curve_ivals) GROUP BY j, band",
    ),
    "curve_exact": (
        ("curve", "curve_asked"),
        "SELECT j, string_agg(n, ',' ORDER BY n) AS shards FROM (SELECT j, n, row_number() OVER (PARTITION BY j ORDER BY round(sum(v * x), 9) DESC, n) AS place FROM curve JOIN curve_asked USING (i) GROUP BY j, n) WHERE place <= 8 GROUP BY j",
    ),
}


def _with(body: str, *parts: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for x in _PARTS[name][0]:
                need(x)
            order.append(name)

    for name in parts:
        need(name)
    head = ",\n".join(f"{name} AS ({_PARTS[name][1]})" for name in order)
    return f"WITH {head}\n{body}" if order else body


def _array(values: str) -> str:
    """Components of centroids after a change, from rows (n, c) of lists."""
    return f"SELECT CAST(n AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS i, round(c[i] / sqrt(list_dot_product(c, c)), 6) + 0.0 AS value FROM ({values}) CROSS JOIN range(1, 65) t(i)"


def statements() -> dict[str, str]:
    rounds = "SELECT query_id, CAST(greatest(1, ceil(log2(least(place, capacity) / 50.0)) + 1) AS INTEGER) AS budget_rounds FROM"
    return {
        "exact_topk": _with("SELECT query_id, rank, id, score FROM topk", "topk"),
        "euclidean_topk": _with(
            "SELECT query_id, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM "
            "(SELECT a.id AS query_id, b.id, round(-list_distance(a.e, b.e), 6) + 0.0 AS score FROM emb a CROSS JOIN emb b WHERE a.id % 20 = 0)) WHERE rank <= 10",
            "emb",
        ),
        "exact_route": _with("SELECT query_id, rank, shard_id, score FROM routed", "routed"),
        "routed_topk": _with("SELECT query_id, rank, id, score FROM routed_top", "routed_top"),
        "candidate_counts": _with("SELECT query_id, CAST(sum(item_count) AS BIGINT) AS candidates, count(*) AS shards FROM routed JOIN sizes USING (shard_id) GROUP BY query_id", "routed", "sizes"),
        "recall_precision": _with(
            "SELECT query_id, round(count(r.id) / 10.0, 6) AS recall, round(count(r.id) / CAST((SELECT count(*) FROM routed_top x WHERE x.query_id = t.query_id) AS DOUBLE), 6) AS precision "
            "FROM topk t LEFT JOIN routed_top r USING (query_id, id) GROUP BY query_id",
            "topk", "routed_top",
        ),
        "calibration_by_probe": _with(
            "SELECT probe, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS least_recall FROM (SELECT query_id, probe, count(*) FILTER (place <= probe) / CAST(count(*) AS DOUBLE) AS recall "
            "FROM topk JOIN shard_places USING (query_id, shard_id) CROSS JOIN (VALUES (1), (2), (3), (5), (10)) p(probe) GROUP BY query_id, probe) GROUP BY probe",
            "topk", "shard_places",
        ),
        "filtered_topk_pre": _with(
            "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM scored WHERE id IN (SELECT id FROM matching)) WHERE rank <= 10", "scored", "matching"
        ),
        "filtered_topk_post": _with(
            "SELECT f.query_id, f.rank, f.id, f.score, b.budget_rounds FROM found f JOIN (" + rounds + " (SELECT r.query_id, max(r.place) AS capacity, coalesce(max(r.place) FILTER (r.good AND r.nth = 10), max(r.place)) AS place FROM ranked r GROUP BY r.query_id)) b USING (query_id)",
            "scored", "routed", "products", "matching",
        ).replace(
            "\nSELECT f.query_id",
            ",\nranked AS (SELECT *, sum(CAST(good AS INTEGER)) OVER (PARTITION BY query_id ORDER BY place) AS nth FROM (SELECT s.query_id, s.id, s.score, s.id IN (SELECT id FROM matching) AS good, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS place "
            "FROM scored s JOIN routed r ON s.query_id = r.query_id AND s.shard_id = r.shard_id WHERE s.id IN (SELECT id FROM products))),\n"
            "found AS (SELECT query_id, CAST(nth AS INTEGER) AS rank, id, score FROM ranked WHERE good AND nth <= 10)\nSELECT f.query_id",
        ),
        "all_results": _with(
            "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM scored WHERE id IN (SELECT id FROM products WHERE lower(brand) = 'brand#11')", "scored", "products"
        ),
        "page_2": _with(
            "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM scored WHERE id IN (SELECT id FROM products WHERE lower(brand) = 'brand#11')) WHERE rank BETWEEN 6 AND 10",
            "scored", "products",
        ),
        "product_lookup": _with("SELECT query_id, rank, id, title, brand, category, price_ron, in_stock FROM topk JOIN products USING (id)", "topk", "products"),
        "normalize_rows": _with("SELECT id, CAST(i AS INTEGER) AS i, round(x, 6) AS value FROM elements", "elements"),
        "shard_centroids": _with("SELECT shard_id, item_count, CAST(i AS INTEGER) AS i, round(v, 6) AS value FROM cents JOIN sizes USING (shard_id)", "cents", "sizes"),
        "shard_radii": _with("SELECT shard_id, round(radius, 6) AS euclidean_radius, round(angle, 6) AS angular_radius FROM gaps", "gaps"),
        "shard_counts": _with("SELECT shard_id, item_count FROM sizes", "sizes"),
        "shard_metadata": _with("SELECT shard_id, item_count, round(radius, 6) AS euclidean_radius, round(angle, 6) AS angular_radius, 'vectors/shard_id=' || shard_id AS path FROM gaps JOIN sizes USING (shard_id)", "gaps", "sizes"),
        "spectrum": _with("SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec", "spec"),
        "residuals": _with("SELECT band, CAST(n AS INTEGER) AS n, round(residual, 6) AS residual FROM resid", "resid"),
        "spectral_scores": _with("SELECT query_id, band, CAST(n AS INTEGER) AS n, round(score, 6) + 0.0 AS score FROM approx", "approx"),
        "score_intervals": _with("SELECT query_id, band, CAST(n AS INTEGER) AS n, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper FROM ivals", "ivals"),
        "interval_coverage": _with(
            "SELECT band, bool_and(lower <= exact + 1e-9 AND exact <= upper + 1e-9) AS covered FROM ivals JOIN (SELECT query_id, shard_id AS n, list_dot_product(q, c) AS exact FROM asked CROSS JOIN centers) USING (query_id, n) GROUP BY band", "ivals", "asked", "centers"
        ),
        "certify_topb": _with("SELECT query_id, band, shards, round(margin, 6) + 0.0 AS margin, margin >= 1e-9 AS certified FROM cert", "cert"),
        "adaptive_route": _with(
            "SELECT j AS query_id, CAST(coalesce(b.band, 16) AS INTEGER) AS used_band, true AS certified, b.band IS NULL AS fallback, CASE WHEN b.band IS NULL THEN 'exact_fallback' ELSE 'spectral_certified' END AS route_mode, coalesce(c.shards, e.shards) AS shards "
            "FROM curve_exact e LEFT JOIN (SELECT j, min(band) AS band FROM curve_cert WHERE certified GROUP BY j) b USING (j) LEFT JOIN curve_cert c USING (j, band)",
            "curve_exact", "curve_cert",
        ),
        "adaptive_route_vectors": _with(
            "SELECT query_id, CAST(coalesce(b.band, 2) AS INTEGER) AS used_band, true AS certified, b.band IS NULL AS fallback, CASE WHEN b.band IS NULL THEN 'exact_fallback' ELSE 'spectral_certified' END AS route_mode, coalesce(c.shards, e.shards) AS shards "
            "FROM (SELECT query_id, string_agg(shard_id, ',' ORDER BY shard_id) AS shards FROM routed GROUP BY query_id) e "
            "LEFT JOIN (SELECT query_id, min(band) AS band FROM cert WHERE band <= 2 AND margin >= 1e-9 GROUP BY query_id) b USING (query_id) LEFT JOIN cert c USING (query_id, band)",
            "routed", "cert",
        ),
        "nearest_center": _with(
            "SELECT id, shard_id, round(score, 6) + 0.0 AS similarity FROM (SELECT id, c.shard_id, list_dot_product(v, c) AS score, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, c.shard_id) AS place FROM unit CROSS JOIN centers c) WHERE place = 1",
            "unit", "centers",
        ),
        "route_mode_counts": _with(
            "SELECT CASE WHEN sure THEN 'spectral_certified' ELSE 'exact_fallback' END AS route_mode, count(*) AS queries FROM (SELECT query_id, bool_or(margin >= 1e-9) AS sure FROM cert WHERE band <= 2 GROUP BY query_id) GROUP BY 1", "cert"
        ),
        "spectral_energy": _with(
            "SELECT band, round(sum(CASE WHEN k <= band THEN p ELSE 0 END) / sum(p), 6) AS energy FROM (SELECT k, CASE WHEN k IN (0, 5) THEN 1 ELSE 2 END * (re * re + im * im) AS p FROM spec) CROSS JOIN (VALUES (0), (1), (2), (5)) b(band) GROUP BY band", "spec"
        ),
        "ordering_quality": _with(
            "SELECT round(avg(g), 6) AS mean_distance, round(median(g), 6) AS median_distance, round(sum(g), 6) AS total_variation FROM (SELECT list_distance(a.c, b.c) AS g FROM centers a JOIN centers b ON b.shard_id = a.shard_id + 1)", "centers"
        ),
        "incremental_spectrum": _with(
            "SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, round(sum(v * cos(2 * pi() * k * n / 10)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * k * n / 10)), 6) + 0.0 AS im "
            "FROM (SELECT n, i, v FROM cents JOIN (SELECT range AS n, CASE WHEN range = 0 THEN 9 ELSE range END AS from_shard FROM range(10)) ON from_shard = shard_id) CROSS JOIN range(6) t(k) GROUP BY k, i",
            "cents",
        ),
        "remove_shard": _with(_array("SELECT row_number() OVER (ORDER BY shard_id) - 1 AS n, c FROM centers WHERE shard_id <> 3"), "centers"),
        "merge_shard": _with(
            _array(
                "SELECT row_number() OVER (ORDER BY shard_id) - 1 AS n, c FROM (SELECT shard_id, c FROM centers WHERE shard_id NOT IN (2, 5) UNION ALL SELECT 2, [(a.c[j] + b.c[j]) / 2 FOR j IN range(1, 65)] FROM centers a, centers b WHERE a.shard_id = 2 AND b.shard_id = 5)"
            ),
            "centers",
        ),
        "add_shard": _with(_array("SELECT shard_id AS n, c FROM centers UNION ALL SELECT 10, [a.c[j] + b.c[j] FOR j IN range(1, 65)] FROM centers a, centers b WHERE a.shard_id = 0 AND b.shard_id = 1"), "centers"),
        "split_shard": _with(
            _array(
                "SELECT shard_id AS n, c FROM centers WHERE shard_id <> 4 UNION ALL SELECT 4, [a.c[j] + b.c[j] FOR j IN range(1, 65)] FROM centers a, centers b WHERE a.shard_id = 4 AND b.shard_id = 0 "
                "UNION ALL SELECT 10, [a.c[j] + b.c[j] FOR j IN range(1, 65)] FROM centers a, centers b WHERE a.shard_id = 4 AND b.shard_id = 1"
            ),
            "centers",
        ),
        "ball_bounds": _with("SELECT query_id, shard_id, round(greatest(-1, least(1, score - radius)), 6) + 0.0 AS lower, round(greatest(-1, least(1, score + radius)), 6) + 0.0 AS upper FROM measured", "measured"),
        "angular_bounds": _with(
            "SELECT query_id, shard_id, round(cos(greatest(0, least(pi(), acos(greatest(-1, least(1, score))) + angle))), 6) + 0.0 AS lower, round(cos(greatest(0, least(pi(), acos(greatest(-1, least(1, score))) - angle))), 6) + 0.0 AS upper FROM measured", "measured"
        ),
        "min_distance_bounds": _with("SELECT query_id, shard_id, round(greatest(0, distance - radius), 6) + 0.0 AS min_distance FROM measured", "measured"),
        "pruning_certificate": _with(
            "SELECT query_id, count(*) AS skipped, round(max(u), 6) AS best_skipped, max(u) <= (SELECT min(score) FROM routed_top t WHERE t.query_id = x.query_id) AS certified "
            "FROM (SELECT query_id, greatest(-1, least(1, score + radius)) AS u FROM measured m WHERE NOT EXISTS (SELECT 1 FROM routed r WHERE r.query_id = m.query_id AND r.shard_id = m.shard_id)) x GROUP BY query_id",
            "measured", "routed", "routed_top",
        ),
        "import_valid": _with("SELECT product_id, title, description, category, brand, price_ron, CAST(NULL AS VARCHAR) AS color, audience, in_stock FROM judged WHERE error IS NULL", "judged"),
        "import_rejects": _with("SELECT line_number, product_id, error FROM judged WHERE error IS NOT NULL", "judged"),
        "import_report": _with("SELECT count(*) AS rows_read, count(*) FILTER (error IS NULL) AS rows_valid, count(error) AS rows_invalid, count(*) FILTER (error = 'duplicate product_id') AS duplicate_ids FROM judged", "judged"),
        "semantic_text": _with(
            "SELECT product_id, 'Titlu: ' || title || '. Descriere: ' || description || '.' || coalesce(' Categorie: ' || category || '.', '') || ' Brand: ' || brand || '.' || coalesce(' Public: ' || audience || '.', '') AS semantic_text FROM judged WHERE error IS NULL", "judged"
        ),
        "tokens": "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)",
        "ngram_features": _with(
            "SELECT feature, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT 'w:' || w AS feature, 2.0::DOUBLE AS weight FROM singles "
            + "".join(f"UNION ALL SELECT 'c{width}:' || substr('^' || w || '$', CAST(s AS BIGINT), {width}), {weight}::DOUBLE FROM (SELECT w, unnest(range(1, length(w) + 2 - {width} + 2)) AS s FROM singles) " for width, weight in ((3, 0.35), (4, 0.25), (5, 0.15)))
            + "UNION ALL SELECT 'b:' || t[k] || '_' || t[k + 1], 0.75::DOUBLE FROM (SELECT t, unnest(range(1, len(t))) AS k FROM words)) GROUP BY feature",
            "singles", "words",
        ),
        "capacity_estimate": "SELECT CAST(1000000000 AS BIGINT) AS items, CAST(16384 AS BIGINT) AS shards, CAST(256 AS BIGINT) AS band, 1e9 / 16384 AS items_per_shard, 1e9 / 16384 * 32 AS routed_items, 16384 / 32.0::DOUBLE AS reduction, CAST(16384 * 768 AS BIGINT) AS exact_multiply_adds, "
        "CAST(257 * 768 AS BIGINT) AS spectral_terms, CAST(5 * 16384 * log2(16384) AS BIGINT) AS inverse_operations, CAST(4 * 16384 * 768 AS BIGINT) AS centroid_bytes_32, CAST(8 * 257 * 768 AS BIGINT) AS spectral_bytes_64, CAST(4 * 7 * 16384 AS BIGINT) AS residual_bytes_32, "
        "round(2.971::DOUBLE + 1 * (8.0 + 1.5) + 0.5, 6) AS total_ms, false AS physical",
        "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
        "synthetic_catalog": _with(
            "SELECT product_id, sub || ' ' || brand || ' ' || series || ' ' || lpad(CAST(sequence AS VARCHAR), 4, '0') AS title, sub || ', seria ' || series || ', pentru ' || use || '. Cu ' || f[(mixed >> 16) % 8 + 1] || ' și ' || f[(mixed >> 21) % 8 + 1] || ', ' || color || '.' AS description, "
            "CAST(category_id AS INTEGER) AS category_id, category, brand, price_ron, color, audience, in_stock FROM made",
            "made",
        ),
        "category_balance": _with("SELECT category, count(*) AS products, count(*) FILTER (in_stock) AS in_stock, min(price_ron) AS cheapest, max(price_ron) AS dearest FROM made GROUP BY category", "made"),
        "constraint_checks": _with(
            "SELECT count(*) AS products, count(*) FILTER (NOT price_ron >= 0) AS bad_prices, CAST(0 AS BIGINT) AS bad_stock, count(*) - count(DISTINCT product_id) AS repeated_ids, count(*) FILTER (category_id NOT BETWEEN 1 AND 256) AS orphans, "
            "count(DISTINCT category) AS categories, (SELECT min(n) FROM (SELECT count(*) AS n FROM made GROUP BY category)) AS smallest, (SELECT max(n) FROM (SELECT count(*) AS n FROM made GROUP BY category)) AS largest FROM made",
            "made",
        ),
        "streaming_shard_counts": _with("SELECT shard_id, item_count FROM sizes", "sizes"),
    }
