"""DuckDB SQL for the same results from the same tables, written against the definitions, not the Spark plans."""

from __future__ import annotations

_EMB = "emb AS (SELECT vec_id AS id, label, unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
_LAY = f"{_EMB}, lay AS (SELECT id, label, dim // 16 AS layer, dim % 16 AS dim, x FROM emb)"
_SPLIT = """split AS (
  SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM embeddings)"""
#: lay4: a vector for each layer; nn: neighbours of the test points within each layer, ranked.
_NN = f"""{_SPLIT}, lay4 AS (
  SELECT vec_id AS id, l::INT AS layer, embedding[l * 16 + 1 : l * 16 + 16]::DOUBLE[] AS v FROM embeddings, range(4) t(l)
), pairs AS (
  SELECT q.id, q.layer, a.label, t.id AS nb, b.label AS nb_label,
    round(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 9) AS d
  FROM lay4 q JOIN split a ON a.id = q.id AND a.is_test JOIN lay4 t ON t.layer = q.layer JOIN split b ON b.id = t.id AND NOT b.is_test
), nn AS (SELECT *, row_number() OVER (PARTITION BY layer, id ORDER BY d, nb) AS r FROM pairs)"""


def _votes(keys: str, ks: str) -> str:
    """pred: the majority label for each k; counts and per-class rows from it."""
    return f"""votes AS (SELECT {keys}, k::INT AS k, id, label, nb_label, count(*) AS n FROM nn, (SELECT unnest({ks}) AS k) WHERE r <= k GROUP BY ALL
), pred AS (SELECT {keys}, k, id, label, first(nb_label ORDER BY n DESC, nb_label) AS pred FROM votes GROUP BY ALL
), conf AS (SELECT {keys}, k, label AS y_true, pred AS y_pred, count(*) AS n FROM pred GROUP BY ALL
), {_classes(f'{keys}, k')}"""


def _classes(keys: str) -> str:
    """From conf (keys, y_true, y_pred, n): per (keys, label, precision, recall, f1, support) and bundle."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""both_ AS (
  SELECT {k}y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT {k}y_pred, 0, n, 0 FROM conf
), per AS (
  SELECT {k}label, sum(support)::BIGINT AS support, coalesce(sum(tp) / nullif(sum(predicted), 0), 0)::DOUBLE AS precision, coalesce(sum(tp) / nullif(sum(support), 0), 0)::DOUBLE AS recall,
    coalesce(2 * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0)::DOUBLE AS f1, sum(tp) AS tp FROM both_ GROUP BY {k}label
), bundle AS (
  SELECT {k}sum(tp) / sum(support) AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(f1) AS macro_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
    count_if(support > 0)::BIGINT AS n_classes, sum(support)::BIGINT AS n_samples FROM per {by})"""


_BUNDLE = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("accuracy", "balanced_accuracy", "macro_f1", "macro_precision", "macro_recall")) + ", n_classes, n_samples"


def _ch(source: str, keys: str, out: str = "ch") -> str:
    """Calinski-Harabasz of (keys, label, dim, x) rows."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_s AS (SELECT {k}label, dim, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM {source} GROUP BY {k}label, dim
), {out}_d AS (SELECT {k}dim, sum(n) AS rows_, count(*) AS k, sum(n * m) / sum(n) AS g, sum(w) AS w, sum(n * m * m) AS q FROM {out}_s GROUP BY {k}dim
), {out} AS (SELECT {k}(sum(q - rows_ * g * g) / (max(k) - 1)) / (sum(w) / (max(rows_) - max(k))) AS score FROM {out}_d {by})"""


def _db(source: str, keys: str, out: str = "db") -> str:
    """Davies-Bouldin of (keys, id, label, dim, x) rows."""
    k = f"{keys}, " if keys else ""
    ak = ", ".join(f"a.{x}" for x in keys.split(", ")) + ", " if keys else ""
    same = " AND ".join([f"a.{x} = b.{x}" for x in keys.split(", ")] + ["a.label <> b.label"]) if keys else "a.label <> b.label"
    by = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_c AS (SELECT {k}label, dim, avg(x) AS m FROM {source} GROUP BY {k}label, dim
), {out}_p AS (SELECT {k}label, id, sqrt(sum((x - m) * (x - m))) AS d FROM {source} JOIN {out}_c USING ({k}label, dim) GROUP BY {k}label, id
), {out}_a AS (SELECT {k}label, avg(d) AS s FROM {out}_p GROUP BY {k}label
), {out}_g AS (SELECT {ak}a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM {out}_c a JOIN {out}_c b ON {same} AND a.dim = b.dim GROUP BY ALL
), {out}_w AS (SELECT {", ".join(f"g.{x}" for x in keys.split(", ")) + ", " if keys else ""}la, max((x.s + y.s) / g.d) AS r FROM {out}_g g
  JOIN {out}_a x ON x.label = la {"".join(f" AND x.{c} = g.{c}" for c in keys.split(", ")) if keys else ""} JOIN {out}_a y ON y.label = lb {"".join(f" AND y.{c} = g.{c}" for c in keys.split(", ")) if keys else ""} GROUP BY ALL
), {out} AS (SELECT {k}avg(r) AS score FROM {out}_w {by})"""


_LAYER_SILHOUETTE = """sp AS (SELECT vec_id AS id, label, l AS layer, embedding[l * 16 + 1 : l * 16 + 16]::DOUBLE[] AS v FROM embeddings, range(4) t(l)
), sd AS (
  SELECT q.layer, q.id, q.label, t.label AS other, avg(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v))) AS m FROM sp q JOIN sp t ON q.layer = t.layer AND q.id <> t.id GROUP BY ALL
), ss AS (SELECT layer, id, max(m) FILTER (other = label) AS a, min(m) FILTER (other <> label) AS b FROM sd GROUP BY layer, id
), sil AS (SELECT layer, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM ss GROUP BY layer)"""
_METRICS = f"""WITH {_LAY}, {_ch("lay", "layer")}, {_db("lay", "layer")}, {_NN}, {_votes("layer", "[5]")}, metrics AS (
  SELECT layer, 'calinski_harabasz' AS metric, round(score, 9) AS value FROM ch UNION ALL SELECT layer, 'davies_bouldin', round(score, 9) FROM db
  UNION ALL SELECT layer, 'knn_accuracy', round(accuracy, 9) FROM bundle UNION ALL SELECT layer, 'knn_balanced_accuracy', round(balanced_accuracy, 9) FROM bundle UNION ALL SELECT layer, 'knn_macro_f1', round(macro_f1, 9) FROM bundle
), merits AS (SELECT *, CASE WHEN metric = 'davies_bouldin' THEN -value ELSE value END AS m FROM metrics
), ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY m DESC NULLS LAST, layer) AS rank FROM merits)"""

_POOL = f"""WITH {_EMB}, w AS (SELECT id, label, exp(sqrt(sum(x * x))) AS e FROM emb GROUP BY id, label
), wn AS (SELECT id, label, e / sum(e) OVER (PARTITION BY label) AS w FROM w
), pooled AS (
  SELECT 'mean' AS method, label, dim, avg(x) AS x FROM emb GROUP BY ALL UNION ALL SELECT 'max', label, dim, max(x) FROM emb GROUP BY ALL
  UNION ALL SELECT 'first', label, dim, arg_min(x, id) FROM emb GROUP BY ALL UNION ALL SELECT 'last', label, dim, arg_max(x, id) FROM emb GROUP BY ALL
  UNION ALL SELECT 'weighted', label, dim, sum(w * x) FROM emb JOIN wn USING (id, label) GROUP BY ALL
  UNION ALL SELECT 'mean_std', label, dim, avg(x) FROM emb GROUP BY ALL UNION ALL SELECT 'mean_std', label, dim + 64, stddev_pop(x) FROM emb GROUP BY ALL)"""

_PEAK = f"WITH {_EMB} SELECT id, dim, round(x / nullif({{level}} OVER (PARTITION BY id), 0), 6) AS x FROM emb"

_JUDGED = f"WITH conf AS (SELECT quality AS y_true, toxic AS y_pred, count(*) AS n FROM labels GROUP BY ALL), {_classes('')}"

_SETS = f"{_EMB}, sets AS (SELECT id AS file_key, dim, x FROM emb)"

_MEANS = ", ".join(f"round({f}({m}), 6)::DOUBLE AS {m}_{s}" for m in ("accuracy", "balanced_accuracy", "macro_f1") for s, f in (("mean", "avg"), ("std", "stddev_pop")))


def _scaling(sizes: str, sets: dict[str, str]) -> str:
    """bundle by features, size and trial, of kNN over labels chosen anew in every trial."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS features, vec_id AS id, label, {part}::DOUBLE[] AS v FROM embeddings" for name, part in sets.items())
    return f"""WITH cfg AS (SELECT n, trial FROM (SELECT unnest({sizes}) AS n), range(5) r(trial)), lab AS (SELECT DISTINCT label FROM embeddings
), chosen AS (SELECT n, trial, label FROM cfg, lab WHERE n <= (SELECT count(*) FROM lab) QUALIFY row_number() OVER (PARTITION BY n, trial ORDER BY md5((trial + 42) || ':' || label), label) <= n
), points AS ({rows}
), rows_ AS (SELECT features, n, trial, id, label, v, row_number() OVER (PARTITION BY features, n, trial, label ORDER BY md5((trial + 42) || ':' || id), id) <= (count(*) OVER (PARTITION BY features, n, trial, label) + 4) // 5 AS is_test FROM points JOIN chosen USING (label)
), nn AS (
  SELECT q.features, q.n AS size, q.trial, q.id, q.label, t.label AS nb_label, row_number() OVER (PARTITION BY q.features, q.n, q.trial, q.id ORDER BY round(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 9), t.id) AS r
  FROM rows_ q JOIN rows_ t ON q.features = t.features AND q.n = t.n AND q.trial = t.trial AND q.is_test AND NOT t.is_test
), {_votes('features, size, trial', '[5]')}"""


SQL: dict[str, str] = {f"pool_{m}": f"{_POOL} SELECT label, dim, round(x, 6) AS x FROM pooled WHERE method = '{m}'" for m in ("mean", "max", "first", "last", "weighted", "mean_std")}
SQL |= {
    "pool_all_methods": f"{_POOL} SELECT label, method, dim, round(x, 6) AS x FROM pooled",
    "pool_nested_frames": f"""WITH {_EMB}, fr AS (SELECT id, dim // 8 AS f, dim % 8 AS dim, x FROM emb), w AS (SELECT id, f, exp(sqrt(sum(x * x))) AS e FROM fr GROUP BY ALL
), wn AS (SELECT id, f, e / sum(e) OVER (PARTITION BY id) AS w FROM w), p AS (
  SELECT id, 'mean' AS method, dim, avg(x) AS x FROM fr GROUP BY ALL UNION ALL SELECT id, 'max', dim, max(x) FROM fr GROUP BY ALL UNION ALL SELECT id, 'first', dim, x FROM fr WHERE f = 0
  UNION ALL SELECT id, 'last', dim, x FROM fr WHERE f = 7 UNION ALL SELECT id, 'weighted', dim, sum(w * x) FROM fr JOIN wn USING (id, f) GROUP BY ALL
  UNION ALL SELECT id, 'mean_std', dim, avg(x) FROM fr GROUP BY ALL UNION ALL SELECT id, 'mean_std', dim + 8, stddev_pop(x) FROM fr GROUP BY ALL
) SELECT id, method, dim::INT AS dim, round(x, 6) AS x FROM p""",
    "event_stats": """SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY user_id""",
    "frame_rms_zcr": f"""WITH {_EMB}, s AS (SELECT id, dim AS t, x, lag(x) OVER (PARTITION BY id ORDER BY dim) AS b FROM emb)
SELECT id, f::INT AS frame, round(sqrt(avg(x * x)), 6) AS rms, round(count_if((x < 0) <> (b < 0) AND t > f * 8) / 16.0::DOUBLE, 6) AS zcr FROM s, range(7) r(f) WHERE t >= f * 8 AND t < f * 8 + 16 GROUP BY id, f""",
    "event_duration_zcr": """WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events
), c AS (SELECT user_id, ts, (d < 0) <> (lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 0) AS c FROM d)
SELECT user_id, date_sub('second', min(ts), max(ts)) AS duration_sec, round(count_if(c) / count(*)::DOUBLE, 6) AS zcr FROM c GROUP BY user_id""",
    "dft_centroid_bandwidth_rolloff": f"""WITH {_EMB}, b AS (SELECT id, f, sum(x * cos(-2 * pi() * f * dim / 64)) AS re, sum(x * sin(-2 * pi() * f * dim / 64)) AS im FROM emb, range(33) r(f) GROUP BY id, f
), m AS (SELECT id, f, sqrt(re * re + im * im) AS m FROM b), a AS (SELECT id, f, m, sum(m) OVER (PARTITION BY id) AS a, sum(m) OVER (PARTITION BY id ORDER BY f) AS g, sum(f * m) OVER (PARTITION BY id) / sum(m) OVER (PARTITION BY id) AS c FROM m)
SELECT id, round(max(c), 6) AS centroid, round(sqrt(sum(m / a * (f - c) * (f - c))), 6) AS bandwidth, min(f) FILTER (round(g, 9) >= round(0.85::DOUBLE * a, 9)) AS rolloff FROM a GROUP BY id""",
    "delta_delta": f"""WITH {_EMB} SELECT id, dim AS t, round({" + ".join(f"({2 * (9 * k * k - 60)} / 2772.0) * {'lead' if k > 0 else 'lag'}(x, {abs(k)}) OVER w" for k in range(-4, 5))}, 6) AS delta FROM emb WINDOW w AS (PARTITION BY id ORDER BY dim)""",
    "delta": f"""WITH {_EMB} SELECT id, dim AS t, round(({" + ".join(f"{k} * {'lead' if k > 0 else 'lag'}(x, {abs(k)}) OVER w" for k in (-4, -3, -2, -1, 1, 2, 3, 4))}) / 60, 6) AS delta FROM emb WINDOW w AS (PARTITION BY id ORDER BY dim)""",
    "peak_normalize": _PEAK.format(level="max(abs(x))"),
    "rms_normalize": f"WITH {_EMB} SELECT id, dim, round(x / sqrt(avg(x * x) OVER (PARTITION BY id)), 6) AS x FROM emb",
    "mono_mix": f"WITH {_EMB} SELECT id, dim % 32 AS dim, round(avg(x), 6) AS x FROM emb GROUP BY id, dim % 32",
    "duration_filter": "SELECT doc_id, n_chars FROM documents WHERE n_chars / 1000.0 BETWEEN 0.1 AND 10",
    "rare_class_filter": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60)",
    "isin_filter": "SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 3, 5)",
    "label_from_path": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS file_key FROM pages), s AS (SELECT *, string_split(file_key, '/') AS a FROM p)
SELECT page_id, file_key, CASE WHEN len(a) > 1 THEN a[-2] ELSE split_part(regexp_replace(a[1], '\.[^.]*$', ''), '_', 1) END AS label FROM s""",
    "call_type_suffix": "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '-') THEN string_split(o_orderpriority, '-')[-1] END AS call_type FROM orders",
    "individual_prefix": "SELECT p_partkey, split_part(replace(p_name, ' ', '_'), '_', 1) AS individual FROM part",
    "folder_normalize": "SELECT p_partkey, replace(lower(string_split('Data/' || p_name, '/')[-1]), ' ', '_') AS folder FROM part",
    "label_encode": "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders",
    "layer_concat": f"WITH {_LAY} SELECT id, (CASE layer WHEN 0 THEN 0 WHEN 2 THEN 16 ELSE 32 END + dim)::INT AS dim, round(x, 6) AS x FROM lay WHERE layer <> 1",
    "layer_mean": f"WITH {_LAY} SELECT id, dim::INT AS dim, round(avg(x), 6) AS x FROM lay GROUP BY ALL",
    "layer_max": f"WITH {_LAY} SELECT id, dim::INT AS dim, round(max(x), 6) AS x FROM lay GROUP BY ALL",
    "layer_weighted_mean": f"WITH {_LAY} SELECT id, dim::INT AS dim, round(sum(x / (layer + 1)) / sum(1 / (layer + 1)), 6) AS x FROM lay GROUP BY ALL",
    "layer_select": f"WITH {_LAY} SELECT id, layer::INT AS layer, dim::INT AS dim, round(x, 6) AS x FROM lay WHERE layer IN (0, 2, 3)",
    "layer_contribution_weights": f"WITH {_LAY}, {_ch('lay', 'layer')} SELECT layer::INT AS layer, round(score, 6) AS score, round(CASE WHEN sum(score) OVER () > 0 THEN score / sum(score) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END, 6) AS weight FROM ch",
    "layer_silhouette": f"WITH {_LAYER_SILHOUETTE} SELECT layer::INT AS layer, round(silhouette, 6) AS silhouette FROM sil",
    "layer_contributions": f"""WITH {_LAYER_SILHOUETTE}, {_LAY}, {_ch('lay', 'layer')}, {_db('lay', 'layer')}, scores AS (
  SELECT 'silhouette' AS metric, layer, silhouette AS score FROM sil UNION ALL SELECT 'calinski', layer, score FROM ch UNION ALL SELECT 'davies_bouldin', layer, 1 / (score + 1e-6) FROM db
) SELECT metric, layer::INT AS layer, round(score, 6) AS score, round(CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END, 6) AS weight FROM scores WINDOW w AS (PARTITION BY metric)""",
    "layer_mean_by_pooling": f"""WITH {_LAY}, p AS (SELECT id, layer, dim % 4 AS dim, avg(x) AS mean, max(x) AS max FROM lay GROUP BY ALL)
SELECT id, 'mean' AS method, dim::INT AS dim, round(avg(mean), 6) AS x FROM p GROUP BY id, dim UNION ALL SELECT id, 'max', dim::INT, round(avg(max), 6) FROM p GROUP BY id, dim""",
    "stats_json": """SELECT source, to_json({source: source, n_files: n, total: t})::VARCHAR AS json FROM (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS t FROM documents GROUP BY source)""",
    "subset_manifest": """WITH c AS (SELECT source AS label, doc_id::VARCHAR AS f FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id::VARCHAR) <= 20)
SELECT label, count(*) AS num_files, string_agg(f, ',' ORDER BY f) AS files, (SELECT count(*) FROM c) AS total_files, 42 AS random_seed FROM c GROUP BY label""",
    "corpus_blocks": """SELECT o_orderstatus, count(*) AS num_files, count(DISTINCT o_custkey) AS num_individuals, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS call_types, round(avg(o_totalprice), 4) AS avg_duration
FROM (SELECT *, CASE WHEN contains(o_orderpriority, '-') THEN string_split(o_orderpriority, '-')[-1] END AS k FROM orders) GROUP BY o_orderstatus""",
    "overall_summary": f"""{_METRICS}, b AS (SELECT layer FROM ranked WHERE metric = 'knn_accuracy' AND rank = 1), v AS (
  SELECT layer, max(value) FILTER (metric = 'knn_accuracy') AS a, max(value) FILTER (metric = 'knn_balanced_accuracy') AS ba, max(value) FILTER (metric = 'knn_macro_f1') AS f FROM metrics JOIN b USING (layer) GROUP BY layer)
SELECT 0 AS place, 'k-NN (Layer ' || layer || '): accuracy ' || printf('%.4f', a) || ', balanced accuracy ' || printf('%.4f', ba) || ', macro F1 ' || printf('%.4f', f) AS line FROM v""",
    "standardize": f"WITH {_EMB} SELECT id, dim, round((x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1), 6) AS x FROM emb WINDOW w AS (PARTITION BY dim)",
    "fusion_concat": f"WITH {_SETS} SELECT file_key, dim, round(x, 6) AS x FROM sets",
    "fusion_weighted": f"WITH {_SETS} SELECT file_key, dim, round(x * CASE WHEN dim < 16 THEN 64 / (16 * 2)::DOUBLE ELSE 64 / (48 * 2)::DOUBLE END, 6) AS x FROM sets",
    "multi_layer_fusion": f"""WITH {_LAY}, m AS (SELECT id, dim, avg(x) AS x FROM lay GROUP BY ALL)
SELECT id AS file_key, dim::INT AS dim, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS x FROM m WINDOW w AS (PARTITION BY dim)""",
    "covariance_matrix": f"WITH {_EMB} SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM emb a JOIN emb b ON a.id = b.id AND a.dim <= b.dim GROUP BY ALL",
    "class_scatter": f"WITH {_EMB} SELECT label, dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS within FROM emb GROUP BY ALL",
    "feature_intersection": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "feature_inner_join": f"WITH {_EMB} SELECT id AS file_key, dim, round(x, 6) AS x FROM emb",
    "label_semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "left_join_metrics": f"WITH {_LAY}, {_ch('lay', 'layer')}, {_NN}, {_votes('layer', '[5]')} SELECT c.layer::INT AS layer, round(score, 6) AS ch, round(coalesce(balanced_accuracy, 0), 6) AS knn FROM ch c LEFT JOIN bundle b ON b.layer = c.layer AND b.layer <> 2",
    "full_outer_layers": f"""WITH {_LAY}, lay8 AS (SELECT id, label, dim // 8 AS layer, dim % 8 AS dim, x FROM emb WHERE dim >= 16), {_ch('lay', 'layer', 'a')}, {_ch('lay8', 'layer', 'b')}
SELECT coalesce(a.layer, b.layer)::INT AS layer, round(coalesce(a.score, 0), 6) AS a, round(coalesce(b.score, 0), 6) AS b FROM a FULL JOIN b ON a.layer = b.layer""",
    "cross_grid_fill": """WITH c AS (SELECT lang, source, avg(n_chars::DOUBLE) AS value FROM documents GROUP BY ALL)
SELECT l.lang, s.source, round(coalesce(c.value, 0), 6) AS value FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN (SELECT DISTINCT source FROM c) s LEFT JOIN c USING (lang, source)""",
    "metric_except": "SELECT * FROM (VALUES ('knn_accuracy', 'Knn Accuracy'), ('silhouette', 'Silhouette')) t(metric, title)",
    "dataset_stats": "SELECT source, count(*) AS n_files, round(avg(n_chars), 6) AS avg_duration, min(n_chars)::DOUBLE AS min_duration, max(n_chars)::DOUBLE AS max_duration, sum(n_chars)::DOUBLE AS total_duration FROM documents GROUP BY source",
    "dataset_stats_estimate": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)
SELECT source, count(*) AS n_files, round(avg(n_chars) FILTER (p <= 10), 6) AS avg_duration, (min(n_chars) FILTER (p <= 10))::DOUBLE AS min_duration, (max(n_chars) FILTER (p <= 10))::DOUBLE AS max_duration,
  round(avg(n_chars) FILTER (p <= 10) * count(*), 6) AS total_duration FROM p GROUP BY source""",
    "distinct_sorted": "SELECT lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT source) AS n_sources, count(*) AS n_files FROM documents GROUP BY lang",
    "totals_rollup": "SELECT lang, count_if(n_chars >= 500)::BIGINT AS n_ok, count(*) AS n_all FROM documents GROUP BY ROLLUP (lang)",
    "subset_sample": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 20",
    "stratified_split": f"WITH {_SPLIT} SELECT id, label, is_test FROM split",
    "stratified_kfold": "SELECT vec_id AS id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings",
    "top10_groups": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "trial_class_sample": "SELECT trial::INT AS trial, label FROM (SELECT DISTINCT label FROM embeddings), range(5) t(trial) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY md5((trial + 42) || ':' || label), label) <= 4",
    "class_weight": "SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6)::DOUBLE AS weight FROM embeddings GROUP BY label",
    "knn_predict_k5": f"""WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), nn AS (
  SELECT q.id, q.label, t.label AS nb_label, row_number() OVER (PARTITION BY q.id ORDER BY round(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 9), t.id) AS r FROM p q JOIN p t ON q.id <> t.id
), c AS (SELECT id, label, nb_label, count(*) AS n FROM nn WHERE r <= 5 GROUP BY ALL) SELECT id, label, first(nb_label ORDER BY n DESC, nb_label) AS pred FROM c GROUP BY id, label""",
    "knn_sweep": f"WITH {_NN}, {_votes('layer', '[3, 5, 7, 9]')} SELECT layer, k, {_BUNDLE} FROM bundle",
    "knn_cv": """WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings), nn AS (
  SELECT q.fold, q.id, q.label, t.label AS nb_label, row_number() OVER (PARTITION BY q.id ORDER BY round(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v)), 9), t.id) AS r FROM p q JOIN p t ON q.fold <> t.fold
), c AS (SELECT k::INT AS k, fold, id, label, nb_label, count(*) AS n FROM nn, (SELECT unnest([3, 5, 7, 9]) AS k) WHERE r <= k GROUP BY ALL
), pr AS (SELECT k, fold, id, label, first(nb_label ORDER BY n DESC, nb_label) AS pred FROM c GROUP BY ALL), s AS (SELECT k, fold, avg((label = pred)::INT) AS s FROM pr GROUP BY ALL)
SELECT k, round(avg(s), 6) AS cv_mean, round(stddev_pop(s), 6) AS cv_std FROM s GROUP BY k""",
    "confusion_matrix": "SELECT quality AS y_true, count_if(toxic = 0)::BIGINT AS pred_0, count_if(toxic = 1)::BIGINT AS pred_1 FROM labels GROUP BY quality",
    "confusion_normalized": "SELECT quality AS y_true, toxic AS y_pred, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY quality))::DOUBLE, 6) AS share FROM labels GROUP BY quality, toxic",
    "accuracy_bundle": f"{_JUDGED} SELECT {_BUNDLE} FROM bundle",
    "per_class_f1": f"{_JUDGED} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per",
    "classification_report": f"""{_JUDGED}, r AS (SELECT label::VARCHAR AS label, precision, recall, f1, support FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""",
    "silhouette_euclidean": f"""WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (
  SELECT q.id, q.label, t.label AS other, avg(list_distance(q.v, t.v)) AS m FROM p q JOIN p t ON q.id <> t.id GROUP BY ALL
), s AS (SELECT id, max(m) FILTER (other = label) AS a, min(m) FILTER (other <> label) AS b FROM d GROUP BY id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "silhouette_cosine": f"""WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (
  SELECT q.id, q.label, t.label AS other, avg(1 - list_dot_product(q.v, t.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(t.v, t.v))) AS m FROM p q JOIN p t ON q.id <> t.id GROUP BY ALL
), s AS (SELECT id, max(m) FILTER (other = label) AS a, min(m) FILTER (other <> label) AS b FROM d GROUP BY id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "calinski_harabasz": f"WITH {_EMB}, {_ch('emb', '')} SELECT round(score, 6) AS score FROM ch",
    "davies_bouldin": f"WITH {_EMB}, {_db('emb', '')} SELECT round(score, 6) AS score FROM db",
    "layer_rank": f"{_METRICS} SELECT metric, layer::INT AS layer, round(value, 6)::DOUBLE AS value, rank FROM ranked",
    "top3_per_metric": f"{_METRICS} SELECT metric, layer::INT AS layer, rank FROM ranked WHERE rank <= 3",
    "minmax_heatmap": f"{_METRICS} SELECT metric, layer::INT AS layer, round((m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0), 6)::DOUBLE AS scaled FROM merits WINDOW w AS (PARTITION BY metric)",
    "best_by_balanced_accuracy": f"{_METRICS} SELECT layer::INT AS layer, round(value, 6)::DOUBLE AS value FROM ranked WHERE metric = 'knn_balanced_accuracy' AND rank = 1",
    "bench_report": f"""{_METRICS}, t AS (SELECT *, rpad(left(array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), ' '), 20), 20, ' ') AS title FROM ranked)
SELECT 1 AS section, lpad(layer::VARCHAR, 3, '0') || metric AS place, 'Layer ' || layer || '  ' || title || '  ' || printf('%.4f', value) AS line FROM t
UNION ALL SELECT 2, metric || rank, title || '  ' || rank || '. layer ' || layer || '  ' || printf('%.4f', value) FROM t WHERE rank <= 3""",
    "flagship": f"WITH {_NN}, {_votes('layer', '[3, 5, 7, 9]')}, c AS (SELECT layer, k, round(balanced_accuracy, 9) AS b FROM bundle) SELECT layer, k, round(b, 6) AS balanced_accuracy, row_number() OVER (ORDER BY b DESC, layer, k) AS rank FROM c",
    "scaling_study": f"""{_scaling("[2, 3, 5, 8, 10, 50]", {"all": "embedding"})}
SELECT size::INT AS n, count(*) AS trials, {_MEANS} FROM bundle GROUP BY size""",
    "scaling_by_features": f"""{_scaling("[2, 5, 10]", {"handcrafted": "embedding[1:16]", "encoder": "embedding[17:64]"})}
SELECT features, 'knn' AS classifier, size::INT AS n, count(*) AS trials, {_MEANS} FROM bundle GROUP BY features, size""",
    "scaling_extremes": """WITH c AS (SELECT label, count(*) AS rows_ FROM embeddings GROUP BY label), r AS (SELECT label, row_number() OVER (ORDER BY rows_ DESC, label) AS most, row_number() OVER (ORDER BY rows_, label) AS least FROM c), n AS (SELECT unnest([2, 4]) AS n)
SELECT 'most' AS selection, n::INT AS n, label FROM r, n WHERE most <= n UNION ALL SELECT 'least', n::INT, label FROM r, n WHERE least <= n""",
}

#: The same results from SQL text over table functions.
SQL |= {"sql_frames": SQL["frame_rms_zcr"], "sql_pooling": SQL["pool_nested_frames"]}
