"""Queries that derive author, venue and paper features, histories and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthcast.features import coauthors as CO, groups as GR, series as SE, tables as FT
from growthcast.plans import fixture as fx
from growthcast.plans.queries_metrics import r
from growthcast.plans.queries_relational import joined, _HIST
from growthcast.plans.registry import cte, query

Q = fx.QUARTERS
STEPS = 20

_MEASURES = """
  sum(base)::BIGINT AS citations, (sum(base) - sum(base_w))::BIGINT AS citations_delta,
  sum(kbase)::BIGINT AS key_citations, (sum(kbase) - sum(kbase_w))::BIGINT AS key_citations_delta,
  sum(d0)::BIGINT AS citations_delta_0, sum(d1)::BIGINT AS citations_delta_1,
  sum(kd0)::BIGINT AS key_citations_delta_0, sum(kd1)::BIGINT AS key_citations_delta_1,
  sum(base) / count(*)::DOUBLE AS mean_citations,
  sum(base) / count(*)::DOUBLE - coalesce(sum(base_w) / nullif(count(*) FILTER (p0 <= 13), 0)::DOUBLE, 0) AS mean_citations_delta,
  sum(base) / (15 - min(p0) + 1)::DOUBLE AS mean_citations_per_year,
  count(*)::BIGINT AS papers, (count(*) - count(*) FILTER (p0 <= 13))::BIGINT AS papers_delta,
  (15 - min(p0) + 1)::INT AS age, max(base)::BIGINT AS max_single,
  count(*) FILTER (base >= rn)::BIGINT AS hindex,
  (count(*) FILTER (base >= rn) - count(*) FILTER (base_w >= rnw))::BIGINT AS hindex_delta"""
cte("am", f"""
SELECT sid, {_MEASURES} FROM (SELECT l.sid, p.*,
  row_number() OVER (PARTITION BY l.sid ORDER BY p.base DESC, p.pid) AS rn,
  row_number() OVER (PARTITION BY l.sid ORDER BY p.base_w DESC, p.pid) AS rnw
  FROM links l JOIN paper p ON p.pid = l.pid) GROUP BY sid""")
cte("vm", f"""
SELECT *, percent_rank() OVER (ORDER BY mean_citations) AS rk FROM (
SELECT venue, {_MEASURES} FROM (SELECT b.p_brand AS venue, p.*,
  row_number() OVER (PARTITION BY b.p_brand ORDER BY p.base DESC, p.pid) AS rn,
  row_number() OVER (PARTITION BY b.p_brand ORDER BY p.base_w DESC, p.pid) AS rnw
  FROM paper p JOIN part b ON b.p_partkey = p.pid) GROUP BY venue)""")
cte("av", "SELECT DISTINCT l.sid, b.p_brand AS venue FROM links l JOIN part b ON b.p_partkey = l.pid")
cte("avm", "SELECT av.sid, vm.* FROM av JOIN vm ON av.venue = vm.venue")
cte("la", "SELECT l.pid, a.* FROM links l JOIN am a ON a.sid = l.sid")


def _pagerank_ctes(tag: str, edges: str) -> None:
    cte(f"{tag}_e", edges)
    cte(f"{tag}_deg", f"SELECT a.sid, coalesce(sum(e.w), 0)::DOUBLE AS deg FROM (SELECT DISTINCT sid FROM links) a "
        f"LEFT JOIN {tag}_e e ON e.sid = a.sid GROUP BY a.sid")
    cte(f"{tag}_0", f"SELECT sid, deg, 1e0 / count(*) OVER () AS rank, count(*) OVER () AS n FROM {tag}_deg")
    for i in range(STEPS):
        cte(f"{tag}_{i + 1}", f"""
SELECT v.sid, v.deg, 0.15e0 / v.n + 0.85e0 * (coalesce(c.s, 0) + (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) FROM {tag}_{i}) / v.n) AS rank, v.n
FROM {tag}_{i} v LEFT JOIN (SELECT e.other AS sid, sum(u.rank * e.w / u.deg) AS s FROM {tag}_e e JOIN {tag}_{i} u ON u.sid = e.sid GROUP BY e.other) c
ON c.sid = v.sid""")


_pagerank_ctes("pru", "SELECT DISTINCT a.sid, b.sid AS other, 1 AS w FROM links a JOIN links b ON a.pid = b.pid AND a.sid <> b.sid")
_pagerank_ctes("prw", "SELECT a.sid, b.sid AS other, count(*) AS w FROM links a JOIN links b ON a.pid = b.pid AND a.sid <> b.sid GROUP BY a.sid, b.sid")
cte("recent", """
SELECT a.sid, coalesce(c.n, 0)::BIGINT AS coauthors FROM (SELECT DISTINCT sid FROM links) a LEFT JOIN (
  SELECT x.sid, count(DISTINCT y.sid) AS n FROM links x JOIN links y ON x.pid = y.pid AND x.sid <> y.sid
  WHERE x.p0 > 13 GROUP BY x.sid) c ON c.sid = a.sid""")
cte("la_rank", "SELECT *, percent_rank() OVER (ORDER BY mean_citations) AS rk FROM am")


def authors(spark, sf):
    return FT.author_measures(fx.authorship(spark, sf), fx.papers(spark, sf), Q)


def author_query(name, columns, rounded=(), rename=None):
    """Register a projection of the author measures."""
    rename = rename or {}
    source = {"max_single_paper_citations": "max_single"}
    sql = ", ".join((f"round({c}, 6)" if c in rounded else source.get(c, c)) + f" AS {rename.get(c, c)}" for c in columns)

    @query(name, f"SELECT sid, {sql} FROM am")
    def run(spark, sf):
        return authors(spark, sf).select("sid", *[
            (F.round(c, 6) if c in rounded else F.col(c)).alias(rename.get(c, c)) for c in columns])


author_query("d01_author_hindex", ["hindex"])
author_query("d02_author_hindex_delta", ["hindex_delta"])
author_query("d03_author_citations", ["citations"])
author_query("d04_author_key_citations", ["key_citations"])
author_query("d05_author_citation_deltas", ["citations_delta_0", "citations_delta_1"])
author_query("d06_author_key_citation_deltas", ["key_citations_delta_0", "key_citations_delta_1"])
author_query("d07_author_mean_citations", ["mean_citations", "mean_citations_delta"], ("mean_citations", "mean_citations_delta"))
author_query("d08_author_citations_per_year", ["mean_citations_per_year"], ("mean_citations_per_year",))
author_query("d09_author_papers", ["papers", "papers_delta"])
author_query("d10_author_age", ["age"])
author_query("d11_author_max_citations", ["max_single_paper_citations"])


@query("d12_author_rank_per_year", "SELECT sid, round(percent_rank() OVER (ORDER BY mean_citations_per_year), 6) AS rank FROM am")
def d12(spark, sf):
    return FT.ranked(authors(spark, sf), "mean_citations_per_year", "rank").select("sid", r("rank"))


@query("d34_author_rank_per_paper", "SELECT sid, round(rk, 6) AS rank FROM la_rank")
def d34(spark, sf):
    return FT.ranked(authors(spark, sf), "mean_citations", "rank").select("sid", r("rank"))


@query("d13_pagerank_unweighted", f"SELECT sid, round(rank, 9) AS rank FROM pru_{STEPS}")
def d13(spark, sf):
    return CO.CoauthorNetwork(fx.authorship(spark, sf)).pagerank(False, STEPS).select("sid", r("rank", digits=9))


@query("d14_pagerank_weighted", f"SELECT sid, round(rank, 9) AS rank FROM prw_{STEPS}")
def d14(spark, sf):
    return CO.CoauthorNetwork(fx.authorship(spark, sf)).pagerank(True, STEPS).select("sid", r("rank", digits=9))


@query("d15_recent_coauthors", """
SELECT a.sid, coalesce(c.n, 0)::BIGINT AS coauthors FROM (SELECT DISTINCT sid FROM links) a LEFT JOIN (
  SELECT x.sid, count(DISTINCT y.sid) AS n FROM links x JOIN links y ON x.pid = y.pid AND x.sid <> y.sid
  WHERE x.p0 > 3 GROUP BY x.sid) c ON c.sid = a.sid""")
def d15(spark, sf):
    # every paper of the tables appears before period 9, so the cut-off here is an early one
    return CO.recent_coauthors(fx.authorship(spark, sf), 3)


def venues(spark, sf):
    return FT.venue_measures(fx.venues(spark, sf), fx.papers(spark, sf), Q)


_SOURCE = {"rank": "rk", "max_single_paper_citations": "max_single"}


def venue_query(name, names):
    columns = {n: FT.VENUE_COLUMNS[n] for n in names}
    sql = ", ".join(f"round({f}({_SOURCE.get(c, c)})::DOUBLE, 6) AS {n}_{s}" for n, c in columns.items()
                    for s, f in zip(FT.STATS, ("avg", "min", "max")))

    @query(name, f"SELECT sid, {sql} FROM avm GROUP BY sid")
    def run(spark, sf):
        feats = FT.author_venue_features(fx.authorship(spark, sf), fx.venues(spark, sf), venues(spark, sf))
        return feats.select("sid", *[F.round(F.col(f"{n}_{s}").cast("double"), 6).alias(f"{n}_{s}")
                                     for n in names for s in FT.STATS])


venue_query("d16_venue_hindex", ["venue_hindex", "venue_hindex_delta"])
venue_query("d17_venue_citations", ["venue_citations", "venue_citations_delta"])
venue_query("d18_venue_papers", ["venue_papers", "venue_papers_delta"])
venue_query("d19_venue_rank", ["venue_rank"])
venue_query("d20_venue_max_citations", ["venue_max_single_paper_citations"])


@query("d21_author_venues", "SELECT sid, CAST(count(*) AS BIGINT) AS total_num_venues FROM av GROUP BY sid")
def d21(spark, sf):
    return FT.author_venue_counts(fx.authorship(spark, sf), fx.venues(spark, sf))


def paper_author_query(name, names):
    columns = {n: FT.PAPER_AUTHOR_COLUMNS[n] for n in names}
    sql = ", ".join(f"round({f}({_SOURCE.get(c, c)})::DOUBLE, 6) AS {n}_{s}" for n, c in columns.items()
                    for s, f in zip(FT.STATS, ("avg", "min", "max")))

    @query(name, f"SELECT pid, {sql} FROM la GROUP BY pid")
    def run(spark, sf):
        links = fx.authorship(spark, sf)
        table = FT.author_measures(links, fx.papers(spark, sf), Q)
        return FT.paper_author_features(links, table, columns).select("pid", *[
            F.round(F.col(f"{n}_{s}").cast("double"), 6).alias(f"{n}_{s}") for n in columns for s in FT.STATS])


paper_author_query("d22_paper_author_hindex", ["author_hindex", "author_hindex_delta"])
paper_author_query("d23_paper_author_citations", [
    "author_citations", "author_citations_delta", "author_key_citations", "author_key_citations_delta"])
paper_author_query("d24_paper_author_mean_citations", ["author_mean_citations", "author_mean_citations_delta"])
paper_author_query("d25_paper_author_papers", ["author_papers", "author_papers_delta"])


def _stats_sql(column, name, digits=6):
    return ", ".join(f"round({f}({column})::DOUBLE, {digits}) AS {name}_{s}" for s, f in zip(FT.STATS, ("avg", "min", "max")))


@query("d26_paper_author_pagerank", f"""
SELECT l.pid, {_stats_sql('u.rank', 'unweighted', 9)}, {_stats_sql('w.rank', 'weighted', 9)}
FROM links l JOIN pru_{STEPS} u ON u.sid = l.sid JOIN prw_{STEPS} w ON w.sid = l.sid GROUP BY l.pid""")
def d26(spark, sf):
    links = fx.authorship(spark, sf)
    net = CO.CoauthorNetwork(links)
    both = (net.pagerank(False, STEPS).withColumnRenamed("rank", "unweighted")
            .join(net.pagerank(True, STEPS).withColumnRenamed("rank", "weighted"), "sid"))
    feats = FT.paper_author_features(net.links, both, {"unweighted": "unweighted", "weighted": "weighted"})
    return feats.select("pid", *[r(f"{n}_{s}", digits=9) for n in ("unweighted", "weighted") for s in FT.STATS])


@query("d27_paper_author_rank_and_reach", f"""
SELECT l.pid, {_stats_sql('a.rk', 'rank')}, {_stats_sql('c.coauthors', 'coauthors')}, {_stats_sql('a.max_single', 'max_single')}
FROM links l JOIN la_rank a ON a.sid = l.sid JOIN recent c ON c.sid = l.sid GROUP BY l.pid""")
def d27(spark, sf):
    links = fx.authorship(spark, sf)
    table = FT.ranked(authors(spark, sf), "mean_citations", "rank").join(
        CO.recent_coauthors(links, Q.source - Q.window), "sid")
    names = {"rank": "rank", "coauthors": "coauthors", "max_single": "max_single_paper_citations"}
    feats = FT.paper_author_features(links, table, names)
    return feats.select("pid", *[F.round(F.col(f"{n}_{s}").cast("double"), 6).alias(f"{n}_{s}")
                                 for n in names for s in FT.STATS])


@query("d28_paper_authors", "SELECT pid, CAST(count(*) AS BIGINT) AS total_num_authors FROM links GROUP BY pid")
def d28(spark, sf):
    return fx.authorship(spark, sf).groupBy("pid").agg(F.count(F.lit(1)).alias("total_num_authors"))


@query("d29_paper_venue", """
SELECT p.pid, hindex::DOUBLE AS venue_hindex, hindex_delta::DOUBLE AS venue_hindex_delta, round(mean_citations, 6) AS venue_mean_citations,
  round(mean_citations_delta, 6) AS venue_mean_citations_delta, papers::DOUBLE AS venue_papers, papers_delta::DOUBLE AS venue_papers_delta,
  round(rk, 6) AS venue_rank, max_single::DOUBLE AS venue_max_single_paper_citations
FROM paper p JOIN part b ON b.p_partkey = p.pid JOIN vm ON vm.venue = b.p_brand""")
def d29(spark, sf):
    papers = fx.papers(spark, sf).select("pid")
    feats = FT.paper_venue_features(fx.venues(spark, sf).join(papers, "pid"), venues(spark, sf))
    return feats.select("pid", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FT.PAPER_VENUE_COLUMNS])


def own(spark, sf):
    return FT.paper_own_features(fx.papers(spark, sf), fx.venues(spark, sf), Q)


@query("d30_paper_age", "SELECT pid, (15 - p0 + 1)::INT AS paper_age FROM paper")
def d30(spark, sf):
    return own(spark, sf).select("pid", "paper_age")


@query("d31_paper_citations", "SELECT pid, base AS paper_citations, kbase AS paper_key_citations FROM paper")
def d31(spark, sf):
    return own(spark, sf).select("pid", "paper_citations", "paper_key_citations")


@query("d32_paper_mean_and_survey", """
SELECT pid, round(base / (15 - p0 + 1)::DOUBLE, 6) AS paper_mean_citations_per_year, (p_type = 'ECONOMY')::INT AS is_survey
FROM paper JOIN part ON p_partkey = pid""")
def d32(spark, sf):
    return own(spark, sf).select("pid", r("paper_mean_citations_per_year"), "is_survey")


@query("d33_paper_deltas", """
SELECT pid, d0 AS paper_citations_delta_0, d1 AS paper_citations_delta_1, kd0 AS paper_key_citations_delta_0, kd1 AS paper_key_citations_delta_1
FROM paper""")
def d33(spark, sf):
    return own(spark, sf).select("pid", "paper_citations_delta_0", "paper_citations_delta_1",
                                 "paper_key_citations_delta_0", "paper_key_citations_delta_1")


cte("ah_long", """
SELECT sid, per, count(*) FILTER (cum >= rn) AS h FROM (
  SELECT *, row_number() OVER (PARTITION BY sid, per ORDER BY cum DESC, pid) AS rn FROM (
    SELECT l.sid, l.pid, t.range AS per, (SELECT count(*) FROM ev WHERE ev.pid = l.pid AND ev.per <= t.range) AS cum
    FROM links l CROSS JOIN range(0, 26) t WHERE t.range >= l.p0))
GROUP BY sid, per""")


@query("d35_histories", f"""
SELECT 'citation' AS measure, row_id, {_HIST} AS hist FROM series_all GROUP BY row_id
UNION ALL SELECT 'hindex', sid, string_agg(h::VARCHAR, ',' ORDER BY per) FROM ah_long WHERE per <= 15 GROUP BY sid""")
def d35(spark, sf):
    papers = fx.papers(spark, sf)
    cited = papers.select(F.lit("citation").alias("measure"), F.col("pid").alias("row_id"), joined(SE.history("n", Q)).alias("hist"))
    h = GR.h_index_series(fx.authorship(spark, sf), papers, "sid", Q)
    return cited.unionByName(h.select(F.lit("hindex").alias("measure"), F.col("sid").alias("row_id"), joined("hist").alias("hist")))


@query("d36_responses", f"""
SELECT 'citation' AS measure, row_id, {', '.join(f'y_{h}::BIGINT AS in_{h}' for h in range(1, 11))} FROM ent_all
UNION ALL SELECT 'hindex', sid, {', '.join(f'(max(h) FILTER (per = {15 + h}))::BIGINT' for h in range(1, 11))} FROM ah_long GROUP BY sid""")
def d36(spark, sf):
    papers = fx.papers(spark, sf)
    cited = papers.select(F.lit("citation").alias("measure"), F.col("pid").alias("row_id"), *SE.responses("n", Q, "in_"))
    h = GR.h_index_series(fx.authorship(spark, sf), papers, "sid", Q)
    return cited.unionByName(h.select(F.lit("hindex").alias("measure"), F.col("sid").alias("row_id"), *[
        F.col(f"hindex_in_{i}").alias(f"in_{i}") for i in range(1, 11)]))


@query("d37_citations_by_period", """
SELECT pid, string_agg(per::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY per) AS citations FROM (
  SELECT ev.pid, ev.per, count(*) AS n FROM ev JOIN paper ON paper.pid = ev.pid GROUP BY ev.pid, ev.per) GROUP BY pid""")
def d37(spark, sf):
    entries = F.filter(F.transform("n", lambda x, i: F.struct((i + Q.start).alias("per"), x.alias("n"))), lambda e: e["n"] > 0)
    by_period = fx.papers(spark, sf).select("pid", F.map_from_entries(entries).alias("m"))
    shown = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return by_period.select("pid", F.array_join(shown, ",").alias("citations"))


cte("a_ent", "SELECT a.sid AS row_id, a.hindex::DOUBLE AS base, a.hindex_delta::DOUBLE AS delta, "
    + ", ".join(f"y_{h}" for h in range(1, 11)) + " FROM am a JOIN (SELECT sid, "
    + ", ".join(f"(max(h) FILTER (per = {15 + h}))::DOUBLE AS y_{h}" for h in range(1, 11))
    + " FROM ah_long GROUP BY sid) y ON y.sid = a.sid WHERE a.hindex >= 4")
cte("a_spl", """
SELECT *, CASE WHEN rn <= least(n // 5, 10000) THEN 'test' WHEN rn <= least(n // 5, 10000) + least(n // 10, 10000) THEN 'valid' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5(row_id || '-12'), row_id) AS rn, count(*) OVER () AS n FROM a_ent)""")
cte("a_long", " UNION ALL ".join(f"SELECT row_id, split, base, delta, {h} AS horizon, y_{h} AS y FROM a_spl" for h in range(1, 11)))


cte("a_mom", """
SELECT horizon, avg(base) m1, avg(delta) m2, avg(y) my, var_pop(base) s11, var_pop(delta) s22,
  covar_pop(base, delta) s12, covar_pop(base, y) c1, covar_pop(delta, y) c2
FROM a_long WHERE split = 'train' GROUP BY horizon""")
cte("a_par", """
SELECT horizon, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *,
  (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM a_mom)""")


def author_run(spark, sf):
    """(wide table of author h-indices, feature names, the run that keeps its models): responses and histories are derived here."""
    from growthcast.config import AUTHOR_HINDEX
    from growthcast.plans import compare as CM
    from growthcast.session import new_table_path
    from growthcast.sources.stored import Run

    links, papers = fx.authorship(spark, sf), fx.papers(spark, sf)
    table = FT.author_measures(links, papers, Q).withColumnRenamed("sid", "row_id")
    renamed = {"hindex": "author_hindex", "hindex_delta": "author_hindex_delta", "citations": "author_citations", "age": "author_age"}
    feats = table.select("row_id", *[F.col(c).cast("double").alias(renamed.get(c, c)) for c in table.columns if c != "row_id"])
    series = GR.h_index_series(links, papers, "sid", Q).withColumnRenamed("sid", "row_id")
    filters = "author_hindex:4"
    wide = CM.prepare(feats, series.drop("hist"), series.select("row_id", "hist"), AUTHOR_HINDEX, filters)
    run = Run(spark, new_table_path(spark, "runs"), Q.run_id(AUTHOR_HINDEX, filters))
    return wide, [c for c in feats.columns if c != "row_id"], run


@query("m16_author_comparison", """
SELECT 'mape' AS metric, model, split, horizon, round(avg(abs((pred - y) / y)), 6) AS value FROM (
  SELECT 'F' AS model, split, horizon, y, base AS pred FROM a_long
  UNION ALL SELECT 'base + h/8', split, horizon, y, base + 0.125e0 * horizon FROM a_long
  UNION ALL SELECT 'SM', split, a_long.horizon, y, greatest(b0 + b1 * base + b2 * delta, base) FROM a_long JOIN a_par ON a_par.horizon = a_long.horizon)
GROUP BY model, split, horizon""")
def m16_authors(spark, sf):
    """The comparison on author h-index, kept under its run's identity."""
    from growthcast.models.baselines import Constant, PlusK, SimpleLinear
    from growthcast.plans import compare as CM

    wide, _, run = author_run(spark, sf)
    models = [CM.OnHorizons(m) for m in (Constant(), PlusK("base + h/8", 0.125), SimpleLinear())]
    done = CM.compare(wide, models, focus="F", run=run)
    return done.metrics.where("metric = 'mape'").select("metric", "model", "split", "horizon", r("value"))


@query("m16_author_models")
def m16_author_models(spark, sf):
    """PK, SM, LAS, RF and GBRT, at their full sizes and with the search, on author h-index."""
    from growthcast.plans import compare as CM

    wide, features, run = author_run(spark, sf)
    return CM.compare(wide, CM.standard_models(features, wide.where("split = 'train'"), False), run=run).metrics


def _digits(column: str) -> int:
    return 9 if "pagerank" in column else 6


def _rounded(df, key):
    return df.select(key, *[F.round(F.col(c).cast("double"), _digits(c)).alias(c) for c in df.columns if c != key])


def _plain_sql(columns: dict[str, str], prefix: str) -> str:
    return ", ".join(f"round({prefix}.{_SOURCE.get(c, c)}::DOUBLE, 6) AS {a}" for a, c in columns.items())


cte("a_rank", "SELECT sid, percent_rank() OVER (ORDER BY mean_citations_per_year) AS rk FROM am")
cte("a_venue", "SELECT sid, count(*) AS n, " + ", ".join(
    f"{f}({_SOURCE.get(c, c)})::DOUBLE AS {n}_{s}" for n, c in FT.VENUE_COLUMNS.items()
    for s, f in zip(FT.STATS, ("avg", "min", "max"))) + " FROM avm GROUP BY sid")


@query("d00_author_table", f"""
SELECT a.sid, {_plain_sql(FT.AUTHOR_COLUMNS, 'a')}, round(k.rk, 6) AS author_mean_citation_rank,
  round(u.rank, 9) AS author_unweighted_pagerank, round(w.rank, 9) AS author_weighted_pagerank,
  c.coauthors::DOUBLE AS author_recent_num_coauthors, v.n::DOUBLE AS total_num_venues,
  {', '.join(f'round(v.{n}_{s}, 6) AS {n}_{s}' for n in FT.VENUE_COLUMNS for s in FT.STATS)}
FROM am a JOIN a_rank k ON k.sid = a.sid JOIN pru_{STEPS} u ON u.sid = a.sid JOIN prw_{STEPS} w ON w.sid = a.sid
JOIN recent c ON c.sid = a.sid JOIN a_venue v ON v.sid = a.sid""")
def d00_authors(spark, sf):
    """All 44 author features."""
    return _rounded(FT.author_table(fx.authorship(spark, sf), fx.papers(spark, sf), fx.venues(spark, sf), Q, STEPS), "sid")


cte("p_authors", "SELECT l.pid, count(*) AS n, " + ", ".join(
    f"{f}({e})::DOUBLE AS {n}_{s}" for n, e in (
        *((n, "a." + _SOURCE.get(c, c)) for n, c in FT.PAPER_AUTHOR_COLUMNS.items()),
        ("author_unweighted_pagerank", "u.rank"), ("author_weighted_pagerank", "w.rank"),
        ("author_recent_num_coauthor", "c.coauthors"), ("author_mean_citation_rank", "a.rk"))
    for s, f in zip(FT.STATS, ("avg", "min", "max"))) + f"""
FROM links l JOIN la_rank a ON a.sid = l.sid JOIN pru_{STEPS} u ON u.sid = l.sid JOIN prw_{STEPS} w ON w.sid = l.sid
JOIN recent c ON c.sid = l.sid GROUP BY l.pid""")
_PAPER_AUTHOR_NAMES = [*FT.PAPER_AUTHOR_COLUMNS, *FT.PAPER_NETWORK_COLUMNS, "author_mean_citation_rank"]


@query("d00_paper_table", f"""
SELECT p.pid, (15 - p.p0 + 1)::DOUBLE AS paper_age, p.base::DOUBLE AS paper_citations, p.kbase::DOUBLE AS paper_key_citations,
  round(p.base / (15 - p.p0 + 1)::DOUBLE, 6) AS paper_mean_citations_per_year, (b.p_type = 'ECONOMY')::INT::DOUBLE AS is_survey,
  p.d0::DOUBLE AS paper_citations_delta_0, p.d1::DOUBLE AS paper_citations_delta_1,
  p.kd0::DOUBLE AS paper_key_citations_delta_0, p.kd1::DOUBLE AS paper_key_citations_delta_1,
  x.n::DOUBLE AS total_num_authors,
  {', '.join(f'round(x.{n}_{s}, {_digits(n)}) AS {n}_{s}' for n in _PAPER_AUTHOR_NAMES for s in FT.STATS)},
  {_plain_sql(FT.PAPER_VENUE_COLUMNS, 'v')}
FROM paper p JOIN part b ON b.p_partkey = p.pid JOIN p_authors x ON x.pid = p.pid JOIN vm v ON v.venue = b.p_brand""")
def d00_papers(spark, sf):
    """All 63 paper features."""
    return _rounded(FT.paper_table(fx.authorship(spark, sf), fx.papers(spark, sf), fx.venues(spark, sf), Q, STEPS), "pid")
