"""Queries over sources, filters, reshapes, joins, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthcast.config import Roles
from growthcast.features import series as SE
from growthcast.functions import scalars as S
from growthcast.models import baselines as B
from growthcast.operators import filters as P, metrics as M, reshape as R, split as SP
from growthcast.plans import fixture as fx, frames as fr
from growthcast.plans.queries_metrics import r
from growthcast.plans.registry import cte, query
from growthcast.session import materialise, new_table_path
from growthcast.sources import graph as G, stored as ST, text as TX

Y = [f"y_{h}" for h in range(1, 11)]
_Y = ", ".join(Y)
_HIST = "string_agg(CAST(CAST(cum AS BIGINT) AS VARCHAR), ',' ORDER BY t)"
_INC = "string_agg(CAST(CAST(inc AS BIGINT) AS VARCHAR), ',' ORDER BY t)"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def paper_hist(spark, sf):
    """(row_id, hist) cumulative histories of all papers."""
    return fx.papers(spark, sf).select(F.col("pid").alias("row_id"), SE.history("n", fx.QUARTERS).alias("hist"))


def paper_inc(spark, sf):
    return fx.papers(spark, sf).select(
        F.col("pid").alias("row_id"), SE.increments_to_source("n", fx.QUARTERS).alias("inc"))


# ---- sources and sinks

@query("s01_table_scan", "SELECT row_id, base AS paper_citations, delta AS paper_citations_delta_0, age::DOUBLE AS paper_age FROM ent_all")
def s01(spark, sf):
    path = new_table_path(spark, "features")
    TX.write_table(fx.paper_entities(spark, sf).select(
        "row_id", F.col("base").alias("paper_citations"), F.col("delta").alias("paper_citations_delta_0"),
        F.col("age").alias("paper_age")), path)
    return TX.read_table(spark, path, "row_id bigint, paper_citations double, paper_citations_delta_0 double, paper_age double")


@query("s02_matrix_scan", f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {', '.join(f'y_{h} AS h{h}' for h in range(1, 11))} FROM ent_all")
def s02(spark, sf):
    path = new_table_path(spark, "matrix")
    ent = materialise(fx.paper_entities(spark, sf).select("row_id", *Y), "entities")
    TX.write_lines(ent.orderBy("row_id").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in Y])), path)
    return TX.read_matrix(spark, path, [f"h{h}" for h in range(1, 11)])


cte("hist", f"SELECT row_id, {_HIST} AS hist, {_INC} AS inc, max(t) AS n FROM series_all GROUP BY row_id")


@query("s03_histories", "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, hist FROM hist")
def s03(spark, sf):
    path = new_table_path(spark, "histories")
    hist = materialise(paper_hist(spark, sf), "hist")
    TX.write_lines(hist.orderBy("row_id").select(F.array_join(F.transform("hist", lambda x: x.cast("string")), "\t")), path)
    return TX.read_histories(spark, path).select("row_id", joined("hist").alias("hist"))


@query("s04_row_position", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, CAST(p_partkey AS VARCHAR) || ':' || p_brand AS value FROM part")
def s04(spark, sf):
    path = new_table_path(spark, "names")
    part = fx.table(spark, sf, "part")
    TX.write_lines(part.orderBy("p_partkey").select(F.concat_ws(":", F.col("p_partkey").cast("string"), "p_brand")), path)
    return TX.numbered_lines(spark, path)


@query("s05_split_members", "SELECT row_id, split FROM spl")
def s05(spark, sf):
    path = new_table_path(spark, "split")
    ST.write_split(SP.holdout_split(fr.entities(spark, sf)), path)
    return ST.read_split(spark, path)


@query("s06_stored_predictions", "SELECT 'RPP' AS model, split, row_id, horizon, y AS pred FROM long")
def s06(spark, sf):
    path = new_table_path(spark, "predictions")
    wide = materialise(fr.split_wide(spark, sf).select("row_id", "split", *[F.col(f"y_{h}").alias(f"h{h}") for h in range(1, 11)]), "wide")
    ST.write_predictions(wide, path, 10)
    return ST.read_predictions(spark, path, wide.select("row_id", "split"), 10, "RPP").select(
        "model", "split", "row_id", "horizon", "pred")


@query("s07_metric_sink", "\nUNION ALL ".join(
    f"SELECT '{c}' AS metric, model, " + ", ".join(f"round(max({c}) FILTER (horizon = {h}), 6) AS \"{2005 + h}\"" for h in range(1, 11))
    + " FROM mape_tab WHERE split = 'test' GROUP BY model" for c in ("mape", "se")))
def s07(spark, sf):
    """The MAPE table and its table of errors, written and read back."""
    path = new_table_path(spark, "mape")
    table = materialise(M.mape_with_error(fr.scored_frame(spark, sf).where("split = 'test'")), "metrics")
    years = [str(2005 + h) for h in range(1, 11)]
    schema = "model string, " + ", ".join(f"`{y}` double" for y in years)
    back = []
    for column, place in (("mape", path), ("se", path + "-errors")):
        ST.write_metric_table(table, place, 10, 2006, column)
        back.append(TX.read_table(spark, place, schema).select(F.lit(column).alias("metric"), "model", *[r(y) for y in years]))
    return back[0].unionByName(back[1])


@query("s08_compressed_text", "SELECT 'bzip2' AS codec, row_id, hist FROM hist UNION ALL SELECT 'gzip', row_id, hist FROM hist")
def s08(spark, sf):
    hist = materialise(paper_hist(spark, sf).select(F.concat_ws("\t", F.col("row_id").cast("string"), joined("hist")).alias("value")), "hist")
    out = []
    for codec in ("bzip2", "gzip"):
        path = new_table_path(spark, codec)
        TX.write_lines(hist, path, codec)
        f = TX.fields("value")
        out.append(TX.lines(spark, path).select(F.lit(codec).alias("codec"), f[0].cast("bigint").alias("row_id"), f[1].alias("hist")))
    return out[0].union(out[1])


@query("s09_snapshot", "SELECT row_id, base, delta FROM ent_all")
def s09(spark, sf):
    path = new_table_path(spark, "snapshot")
    build = lambda: fx.paper_entities(spark, sf).select("row_id", "base", "delta")
    ST.read_or_build(spark, path, build)
    return ST.read_or_build(spark, path, build)


@query("s10_model_artefact", "SELECT horizon, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM sm_par")
def s10(spark, sf):
    path = new_table_path(spark, "model")
    frame = fr.long_frame(spark, sf)

    def get():
        return ST.load_or_train(spark, path, lambda p: B.SimpleLinear().load(spark, p),
                                lambda: B.SimpleLinear().fit(fr.train_rows(frame)), lambda m, p: m.save(p))

    get()
    return get().params.select("horizon", r("b0"), r("b1"), r("b2"))


def citation_records(spark, sf, key_only):
    lines = fx.table(spark, sf, "lineitem")
    if key_only:
        lines = lines.where("l_returnflag = 'R'")
    return G.edge_records(lines.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"),
                                       F.col("l_linenumber").alias("place")))


@query("s11_citation_graph", """
SELECT 'all' AS graph, l_orderkey::VARCHAR AS citing, l_partkey::VARCHAR AS cited, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'key', l_orderkey::VARCHAR, l_partkey::VARCHAR, CAST(count(*) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""")
def s11(spark, sf):
    out = []
    for name, key_only in (("all", False), ("key", True)):
        path = new_table_path(spark, "graph")
        citation_records(spark, sf, key_only).write.json(path)
        out.append(G.read_edges(spark, path).withColumn("graph", F.lit(name)))
    return out[0].union(out[1]).groupBy("graph", "citing", "cited").agg(F.count(F.lit(1)).alias("n"))


def metadata(spark, sf):
    """Paper records; author ids are cut into blocks of at most 100 per record."""
    links = fx.authorship(spark, sf)
    lists = links.groupBy("pid", F.floor(F.col("sid") / 100).alias("_c")).agg(
        F.collect_list(F.col("sid").cast("string")).alias("authors"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.struct(
        (t + 1995).cast("string").alias("key"), F.get("n", t).cast("int").alias("value")))
    years = F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))
    return (fx.papers(spark, sf).join(fx.venues(spark, sf), "pid").join(lists, "pid")
            .select(F.col("pid").cast("string").alias("id"), F.col("p0").alias("year"), "venue",
                    F.col("is_survey").alias("is-survey"), "authors", years.alias("citations-in-year")))


cte("links", """
SELECT DISTINCT ev.pid, ev.sid, paper.p0 FROM ev JOIN paper ON ev.pid = paper.pid AND ev.per = paper.p0""")


@query("s12_paper_metadata", """
SELECT p.pid::VARCHAR AS id, p.p0 AS year, b.p_brand AS venue, b.p_type = 'ECONOMY' AS is_survey,
  (SELECT CAST(count(*) AS BIGINT) FROM links l WHERE l.pid = p.pid) AS n_authors, p.base AS citations
FROM paper p JOIN part b ON b.p_partkey = p.pid""")
def s12(spark, sf):
    path = new_table_path(spark, "papers")
    metadata(spark, sf).write.json(path)
    papers = G.read_papers(spark, path)
    authors = G.paper_authors(papers).groupBy("id").agg(F.count(F.lit(1)).alias("n_authors"))
    # the map repeats in each record of a paper
    counts = (G.paper_year_counts(papers).distinct().groupBy("id").agg(F.sum("citations").alias("citations")))
    return G.paper_facts(papers).join(authors, "id").join(counts, "id")


@query("s13_names", "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, 'part-' || row_id AS id, base FROM ent_all")
def s13(spark, sf):
    names, feats = new_table_path(spark, "names"), new_table_path(spark, "features")
    ent = materialise(fx.paper_entities(spark, sf).select("row_id", "base"), "entities").orderBy("row_id")
    TX.write_lines(ent.select(F.concat(F.lit("part-"), F.col("row_id").cast("string"))), names)
    TX.write_lines(ent.select(F.col("base").cast("string")), feats)
    return R.align(TX.read_names(spark, names), TX.read_matrix(spark, feats, ["base"]))


# ---- projections and filters

def wide_responses(spark, sf):
    """Responses of two measures side by side, as the published files have them."""
    p = fx.papers(spark, sf)
    return p.select(F.col("pid").alias("row_id"), *SE.responses("n", fx.QUARTERS, "total_citations_in_"),
                    *SE.responses("k", fx.QUARTERS, "key_in_"))


@query("p01_columns_of_measure", "SELECT row_id, " + ", ".join(f"y_{h}::BIGINT AS total_citations_in_{h}" for h in range(1, 11)) + " FROM ent_all")
def p01(spark, sf):
    return P.columns_of_measure(wide_responses(spark, sf), "citation")


ENTITY_ROLES = Roles("paper", "citation", "base", "base", "average", "delta", "age")


@query("p02_role_columns", "SELECT row_id, base, delta, round(average, 6) AS average, age::DOUBLE AS age FROM ent_all")
def p02(spark, sf):
    return P.role_columns(fx.paper_entities(spark, sf), ENTITY_ROLES).withColumn("average", F.round("average", 6))


@query("p03_parse_filters", "SELECT 'age:10,14-base:15' AS filter_id, row_id, base, age FROM ent_all WHERE base >= 15 AND age BETWEEN 10 AND 14")
def p03(spark, sf):
    bounds, fid = P.parse_filters("base:15;age:10,14")
    ent = fx.paper_entities(spark, sf).where(P.range_predicate(bounds))
    return ent.select(F.lit(fid).alias("filter_id"), "row_id", "base", "age")


@query("p04_range_filter", "SELECT row_id, delta / delta_1 AS ratio FROM ent_all WHERE delta_1 > 0 AND delta / delta_1 >= 1")
def p04(spark, sf):
    # 0/0 is NaN here and never qualifies
    ratio = F.when(F.col("delta_1") > 0, F.col("delta") / F.col("delta_1")).when(F.col("delta") == 0, F.lit(float("nan")))
    ent = fx.paper_entities(spark, sf).select("row_id", ratio.alias("ratio"))
    return P.apply_filters(ent, "ratio:1")


@query("p05_nonzero_truth", "SELECT row_id, base AS pred, delta AS y FROM ent_all WHERE delta <> 0")
def p05(spark, sf):
    return P.drop_zero_truth(fx.paper_entities(spark, sf).select("row_id", F.col("base").alias("pred"), F.col("delta").alias("y")))


@query("p06_integer_groups", "SELECT average AS g, CAST(count(*) AS BIGINT) AS n FROM ent_all WHERE average = floor(average) AND average >= 1 GROUP BY average")
def p06(spark, sf):
    ent = fx.paper_entities(spark, sf).select(F.col("average").alias("g"))
    return P.integer_groups(ent, "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("p07_zero_truth_guard", """
SELECT age, CAST(count(*) FILTER (delta = 0) AS BIGINT) AS zero_rows, CAST(count(*) AS BIGINT) AS n_rows FROM ent_all GROUP BY age""")
def p07(spark, sf):
    return P.zero_truth_report(fx.paper_entities(spark, sf).select("age", F.col("delta").alias("y")), ["age"])


@query("p08_clamp", "SELECT row_id, greatest(round(delta * 8.5e0, 6), base) AS pred FROM ent_all")
def p08(spark, sf):
    return fx.paper_entities(spark, sf).select(
        "row_id", S.clamp_to_base(F.round(F.col("delta") * 8.5, 6), "base").alias("pred"))


@query("p09_model_subset", """
SELECT model, CAST(CASE model WHEN 'Variable k' THEN 1 ELSE 2 END AS INT) AS ord, horizon, round(mape, 6) AS mape
FROM mape_tab WHERE split = 'test' AND model IN ('Variable k', 'F')""")
def p09(spark, sf):
    test = fr.scored_frame(spark, sf).where("split = 'test'")
    return P.models_in_order(M.mape(test), ["Variable k", "F"]).select("model", "ord", "horizon", r("mape"))


@query("p10_gather", "SELECT row_id, base FROM ent_all WHERE row_id IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def p10(spark, sf):
    chosen = fx.venues(spark, sf).where("is_survey").select(F.col("pid").alias("row_id"))
    return R.gather(fx.paper_entities(spark, sf).select("row_id", "base"), chosen)


# ---- reshape

@query("r01_stack_horizons", "SELECT row_id, split, horizon, round(horizon * average, 6) AS scaled, y FROM long")
def r01(spark, sf):
    return fr.long_frame(spark, sf).select(
        "row_id", "split", "horizon", F.round(F.col("horizon") * F.col("average"), 6).alias("scaled"), "y")


@query("r02_predictions_matrix", "SELECT row_id, " + ", ".join(
    f"round(max(pred) FILTER (horizon = {h}), 6) AS h{h}" for h in range(1, 11)) + " FROM preds WHERE model = 'SM' GROUP BY row_id")
def r02(spark, sf):
    frame = fr.long_frame(spark, sf)
    preds = B.SimpleLinear().fit(fr.train_rows(frame)).predict(frame)
    return R.predictions_matrix(preds, 10).select("row_id", *[r(f"h{h}") for h in range(1, 11)])


@query("r03_all_predictions", "SELECT model, split, row_id, horizon, round(pred, 6) AS pred FROM preds")
def r03(spark, sf):
    frame = fr.long_frame(spark, sf)
    train = fr.train_rows(frame)
    models = [B.Constant(), B.SimpleLinear().fit(train), B.VariableK().fit(train)]
    return B.predict_all(frame, models).select("model", "split", "row_id", "horizon", F.round("pred", 6).alias("pred"))


@query("r04_metric_by_year", "SELECT model, " + ", ".join(
    f"round(max(rsq) FILTER (horizon = {h}), 6) AS \"{2005 + h}\"" for h in range(1, 11)) + " FROM rsq_tab WHERE split = 'test' GROUP BY model")
def r04(spark, sf):
    rsq = M.r_squared(fr.scored_frame(spark, sf).where("split = 'test'"))
    wide = R.metric_by_year(rsq, 10, 2006, "rsq")
    return wide.select("model", *[r(str(2005 + h)) for h in range(1, 11)])


@query("r05_increments", "SELECT row_id, inc FROM hist")
def r05(spark, sf):
    return paper_hist(spark, sf).select("row_id", joined(S.cumulative_to_increments("hist")).alias("inc"))


@query("r06_series_long", "SELECT row_id, t, CAST(cum AS BIGINT) AS value FROM series_all")
def r06(spark, sf):
    long = R.series_long(paper_hist(spark, sf), "hist")
    return R.series_long(R.series_array(long), "series")


@query("r07_replace_rows", """
SELECT model, horizon, round(CASE WHEN model = 'F' THEN 0.5e0 ELSE mape END, 6) AS mape FROM mape_tab WHERE split = 'test'""")
def r07(spark, sf):
    table = materialise(M.mape(fr.scored_frame(spark, sf).where("split = 'test'")).select("model", "horizon", "mape"), "metrics")
    fresh = table.where("model = 'F'").withColumn("mape", F.lit(0.5))
    return R.replace_rows(table, fresh, ["model"]).select("model", "horizon", r("mape"))


# ---- joins

@query("j01_align", "SELECT e.row_id, e.base, e.y_10, h.hist, 'part-' || e.row_id AS id FROM ent_all e JOIN hist h ON h.row_id = e.row_id")
def j01(spark, sf):
    p = fx.papers(spark, sf)
    ent = SE.entity_table(p, "pid", "n", fx.QUARTERS)
    names = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"))
    hist = p.select(F.col("pid").alias("row_id"), joined(SE.history("n", fx.QUARTERS)).alias("hist"))
    return R.align(ent.select("row_id", "base"), ent.select("row_id", "y_10"), hist, names)


@query("j02_restrict_to_split", "SELECT row_id, base FROM spl WHERE split = 'test'")
def j02(spark, sf):
    ent = fr.entities(spark, sf)
    return R.restrict_to_split(ent.select("row_id", "base"), SP.holdout_split(ent), "test")


@query("j03_remove_rows", "SELECT row_id, base FROM spl WHERE split = 'train'")
def j03(spark, sf):
    ent = fr.entities(spark, sf)
    # the hold-out has at most 20,000 rows
    return R.remove_rows(ent.select("row_id", "base"), F.broadcast(SP.holdout_rows(ent)))


@query("j04_score_against_truth", "SELECT model, split, row_id, horizon, base, y, round(pred, 6) AS pred FROM scored WHERE model = 'SM'")
def j04(spark, sf):
    frame = fr.long_frame(spark, sf)
    sm = B.SimpleLinear().fit(fr.train_rows(frame)).predict(frame)
    preds = sm.select(F.lit("SM").alias("model"), "split", "row_id", "horizon", "pred")
    truth = frame.select("row_id", "split", "horizon", "base", "y")
    return R.score_against(preds, truth).select("model", "split", "row_id", "horizon", "base", "y", r("pred"))


@query("j05_growth_over_base", "SELECT row_id, horizon, y - base AS growth FROM long")
def j05(spark, sf):
    return fr.long_frame(spark, sf).select("row_id", "horizon", (F.col("y") - F.col("base")).alias("growth"))


@query("j06_missing_stored", "SELECT split, row_id FROM spl WHERE base < 10")
def j06(spark, sf):
    wide = fr.split_wide(spark, sf)
    stored = wide.where("base >= 10").select("split", "row_id")
    return ST.missing_predictions(stored, wide.select("split", "row_id"))


# ---- order, sampling

@query("t09_sorted_members", "SELECT row_id FROM spl WHERE split = 'valid' ORDER BY row_id")
def t09(spark, sf):
    return SP.sorted_members(SP.holdout_split(fr.entities(spark, sf)), "valid")


@query("f01_holdout_split", "SELECT row_id, split FROM spl")
def f01(spark, sf):
    return SP.holdout_split(fr.entities(spark, sf))


@query("f02_contiguous_folds", """
SELECT row_id, CAST(CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1)
  ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INT) AS fold
FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM spl WHERE split = 'train')""")
def f02(spark, sf):
    train = fr.split_wide(spark, sf).where("split = 'train'").select("row_id")
    return SP.contiguous_folds(train, 10)


# ---- windows

@query("w01_running_sum_before", "SELECT row_id, t, 10 + CAST(cum - inc AS DOUBLE) AS before FROM series_all")
def w01(spark, sf):
    before = paper_inc(spark, sf).select("row_id", S.shifted_running_sum("inc").alias("before"))
    return R.series_long(before, "before", "before")


cte("key_series", """
SELECT p.pid AS row_id, p.p0, t.range - p.p0 + 1 AS t, coalesce(c.n, 0) AS inc, 15 - p.p0 + 1 AS len
FROM paper p CROSS JOIN range(0, 16) t
LEFT JOIN (SELECT pid, per, count(*) AS n FROM ev WHERE key GROUP BY pid, per) c ON c.pid = p.pid AND c.per = t.range
WHERE t.range >= p.p0""")


@query("w02_history_span", """
SELECT row_id, CAST(coalesce(min(t) FILTER (inc <> 0), 1) AS INT) AS lo, CAST(coalesce(max(t) FILTER (inc <> 0), max(len)) AS INT) AS hi
FROM key_series GROUP BY row_id""")
def w02(spark, sf):
    k = fx.papers(spark, sf).select(F.col("pid").alias("row_id"), SE.increments_to_source("k", fx.QUARTERS).alias("k"))
    lo, hi = S.history_span("k")
    return k.select("row_id", lo.alias("lo"), hi.alias("hi"))


# ---- scalar functions

@query("x01_percentage_errors", "SELECT model, row_id, horizon, round((pred - y) / y, 6) AS pe, round(abs((pred - y) / y), 6) AS ape FROM scored WHERE split = 'test'")
def x01(spark, sf):
    return fr.scored_frame(spark, sf).where("split = 'test'").select(
        "model", "row_id", "horizon", F.round(S.signed_pe("pred", "y"), 6).alias("pe"), F.round(S.ape("pred", "y"), 6).alias("ape"))


@query("x02_squared_errors", """
SELECT row_id, horizon, (base - y) ** 2 AS err, round((y - base - avg(y - base) OVER (PARTITION BY horizon)) ** 2, 6) AS centred FROM long""")
def x02(spark, sf):
    frame = fr.long_frame(spark, sf)
    growth = F.col("y") - F.col("base")
    means = frame.groupBy("horizon").agg(F.avg(growth).alias("m"))
    # one row per horizon
    return frame.join(F.broadcast(means), "horizon").select(
        "row_id", "horizon", S.squared_error("base", "y").alias("err"), F.round(S.centred_square(growth, "m"), 6).alias("centred"))


@query("x05_softplus", "SELECT row_id, round(greatest(base - 15, 0) + ln(1 + exp(-abs(base - 15))) + 0.001e0, 6) AS value FROM ent_all")
def x05(spark, sf):
    return fx.paper_entities(spark, sf).select("row_id", F.round(S.softplus(F.col("base") - 15), 6).alias("value"))


@query("x06_lognormal_start", """
SELECT row_id, round(ln(a), 6) AS mu, round(sqrt(2e0) * sqrt(ln(m / a)), 6) AS sigma FROM (
  SELECT row_id, m, sqrt(m ** 4 / (m ** 2 + greatest(m, 1e0))) AS a FROM (SELECT row_id, age / 2e0 AS m FROM ent_all))""")
def x06(spark, sf):
    mu, sigma = S.lognormal_start(F.col("age") / 2.0)
    return fx.paper_entities(spark, sf).select("row_id", F.round(mu, 6).alias("mu"), F.round(sigma, 6).alias("sigma"))


@query("x07_bad_numbers", "SELECT row_id, delta_1 = 0 AS bad FROM ent_all")
def x07(spark, sf):
    q = (F.when(F.col("delta_1") > 0, F.col("delta") / F.col("delta_1"))
         .when(F.col("delta") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return fx.paper_entities(spark, sf).select("row_id", S.is_bad(q).alias("bad"))


@query("x08_span_mid", "SELECT row_id, (p0 + 1 + 16) / 2e0 AS mid FROM ent_all")
def x08(spark, sf):
    return fx.papers(spark, sf).select(F.col("pid").alias("row_id"), S.span_mid(F.col("p0") + 1, F.lit(16)).alias("mid"))


@query("x09_array_dot", "SELECT row_id, CAST(sum(inc * cum) AS DOUBLE) AS dot FROM series_all GROUP BY row_id")
def x09(spark, sf):
    return fx.papers(spark, sf).select(F.col("pid").alias("row_id"), S.array_dot(
        SE.increments_to_source("n", fx.QUARTERS), SE.history("n", fx.QUARTERS)).alias("dot"))


@query("x10_labels", """
SELECT p_partkey AS row_id, contains(lower(p_name), 'red') AS has, replace(replace(p_brand || ':' || p_type || ',x', ':', '_'), ',', '_') AS label FROM part""")
def x10(spark, sf):
    return fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), S.name_has("p_name", "Red").alias("has"),
        S.normalise_label(F.concat_ws(":", "p_brand", F.concat("p_type", F.lit(",x")))).alias("label"))


@query("u03_column_predicate", "SELECT row_id, y_10::BIGINT AS total_citations_in_10, k10 AS key_in_10 FROM ent_all JOIN (SELECT pid, CAST(count(*) FILTER (key AND per <= 25) AS BIGINT) AS k10 FROM ev GROUP BY pid) ON pid = row_id")
def u03(spark, sf):
    return P.columns_where(wide_responses(spark, sf), lambda c: c.endswith("_10"))


@query("a15_history_terms", """
SELECT row_id, CAST(sum(inc) AS BIGINT) AS n, round(sum(inc * ln(10 + cum - inc)), 6) AS log_term FROM series_all GROUP BY row_id""")
def a15(spark, sf):
    p = paper_inc(spark, sf)
    return p.select("row_id", F.aggregate("inc", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"),
                    F.round(S.history_log_term("inc"), 6).alias("log_term"))


@query("m10_initial_state", """
SELECT row_id, 10e0 AS m, round(ln(a), 6) AS mu, round(sqrt(2e0) * sqrt(ln(mid / a)), 6) AS sigma FROM (
  SELECT row_id, mid, sqrt(mid ** 4 / (mid ** 2 + greatest(mid, 1e0))) AS a FROM (
    SELECT row_id, (min(t) FILTER (inc <> 0) + max(t) FILTER (inc <> 0)) / 2e0 AS mid FROM series_all GROUP BY row_id))""")
def m10(spark, sf):
    lo, hi = S.history_span("inc")
    mu, sigma = S.lognormal_start(S.span_mid(lo, hi))
    return paper_inc(spark, sf).select("row_id", F.lit(10.0).alias("m"), F.round(mu, 6).alias("mu"), F.round(sigma, 6).alias("sigma"))
