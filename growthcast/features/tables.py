"""The author, venue and paper feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from growthcast.config import TimeAxis
from growthcast.features.coauthors import CoauthorNetwork, recent_coauthors
from growthcast.features.groups import group_measures, paper_facts
from growthcast.operators.ranking import percent_rank
from growthcast.session import materialise

STATS = ("mean", "min", "max")


def summaries(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Mean, min and max per key of several columns: ``<name>_{mean,min,max}``."""
    aggs = []
    for name, c in columns.items():
        aggs += [F.avg(c).alias(f"{name}_mean"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return rows.groupBy(key).agg(*aggs)


def author_measures(links: DataFrame, papers: DataFrame, axis: TimeAxis) -> DataFrame:
    return group_measures(links, paper_facts(papers, axis), "sid", axis)


def ranked(measures: DataFrame, value: str, out: str) -> DataFrame:
    """Measures with their 0-1 rank; written first, as their rows are counted before they are dealt to ranges."""
    return percent_rank(materialise(measures, "measures"), value, out)


def venue_measures(venue_of: DataFrame, papers: DataFrame, axis: TimeAxis) -> DataFrame:
    table = group_measures(venue_of, paper_facts(papers, axis), "venue", axis)
    return ranked(table, "mean_citations", "rank")


VENUE_COLUMNS = {
    "venue_hindex": "hindex", "venue_hindex_delta": "hindex_delta",
    "venue_citations": "mean_citations", "venue_citations_delta": "mean_citations_delta",
    "venue_papers": "papers", "venue_papers_delta": "papers_delta",
    "venue_rank": "rank", "venue_max_single_paper_citations": "max_single_paper_citations"}


def author_venues(links: DataFrame, venue_of: DataFrame) -> DataFrame:
    """Distinct (sid, venue)."""
    return links.select("pid", "sid").join(venue_of.select("pid", "venue"), "pid").select("sid", "venue").distinct()


def author_venue_counts(links: DataFrame, venue_of: DataFrame) -> DataFrame:
    return author_venues(links, venue_of).groupBy("sid").agg(F.count(F.lit(1)).alias("total_num_venues"))


def author_venue_features(links: DataFrame, venue_of: DataFrame, venues: DataFrame) -> DataFrame:
    """Summaries over the distinct venues of each author."""
    return summaries(author_venues(links, venue_of).join(venues, "venue"), "sid", VENUE_COLUMNS)


def author_network_features(links: DataFrame, axis: TimeAxis, iterations: int = 20) -> DataFrame:
    net = CoauthorNetwork(links)
    plain = net.pagerank(False, iterations).withColumnRenamed("rank", "author_unweighted_pagerank")
    heavy = net.pagerank(True, iterations).withColumnRenamed("rank", "author_weighted_pagerank")
    recent = recent_coauthors(links, axis.source - axis.window).withColumnRenamed(
        "coauthors", "author_recent_num_coauthors")
    return plain.join(heavy, "sid").join(recent, "sid")


AUTHOR_COLUMNS = {
    "author_hindex": "hindex", "author_hindex_delta": "hindex_delta", "author_citations": "citations",
    "author_key_citations": "key_citations", "author_citations_delta_0": "citations_delta_0",
    "author_citations_delta_1": "citations_delta_1", "author_key_citations_delta_0": "key_citations_delta_0",
    "author_key_citations_delta_1": "key_citations_delta_1", "author_mean_citations_per_paper": "mean_citations",
    "author_mean_citation_per_paper_delta": "mean_citations_delta",
    "author_mean_citations_per_year": "mean_citations_per_year", "author_papers": "papers",
    "author_papers_delta": "papers_delta", "author_age": "age",
    "author_max_single_paper_citations": "max_single_paper_citations"}


def author_table(links: DataFrame, papers: DataFrame, venue_of: DataFrame, axis: TimeAxis,
                 iterations: int = 20) -> DataFrame:
    """The 44 author features, keyed by ``sid``. Links and papers are read many times, so both are written first."""
    links, papers = materialise(links, "links"), materialise(papers, "papers")
    measures = author_measures(links, papers, axis)
    own = ranked(measures, "mean_citations_per_year", "author_mean_citation_rank").select(
        "sid", "author_mean_citation_rank",
        *[F.col(c).alias(a) for a, c in AUTHOR_COLUMNS.items()])
    at_venues = (author_venue_features(links, venue_of, venue_measures(venue_of, papers, axis))
                 .join(author_venue_counts(links, venue_of), "sid"))
    return own.join(author_network_features(links, axis, iterations), "sid").join(at_venues, "sid")


PAPER_AUTHOR_COLUMNS = {
    "author_hindex": "hindex", "author_hindex_delta": "hindex_delta", "author_citations": "citations",
    "author_citations_delta": "citations_delta", "author_key_citations": "key_citations",
    "author_key_citations_delta": "key_citations_delta", "author_mean_citations": "mean_citations",
    "author_mean_citations_delta": "mean_citations_delta", "author_papers": "papers",
    "author_papers_delta": "papers_delta",
    "author_max_single_paper_citations": "max_single_paper_citations"}
PAPER_NETWORK_COLUMNS = {
    "author_unweighted_pagerank": "author_unweighted_pagerank",
    "author_weighted_pagerank": "author_weighted_pagerank",
    "author_recent_num_coauthor": "author_recent_num_coauthors"}
PAPER_VENUE_COLUMNS = {
    "venue_hindex": "hindex", "venue_hindex_delta": "hindex_delta", "venue_mean_citations": "mean_citations",
    "venue_mean_citations_delta": "mean_citations_delta", "venue_papers": "papers",
    "venue_papers_delta": "papers_delta", "venue_rank": "rank",
    "venue_max_single_paper_citations": "max_single_paper_citations"}


def paper_own_features(papers: DataFrame, survey_of: DataFrame, axis: TimeAxis) -> DataFrame:
    age = (F.lit(axis.source) - F.col("p0") + 1).cast("int")
    # papers without a survey flag stay, with a NULL flag
    return paper_facts(papers, axis).join(survey_of.select("pid", "is_survey"), "pid", "left").select(
        "pid", age.alias("paper_age"), F.col("cites").alias("paper_citations"), F.col("keys").alias("paper_key_citations"),
        (F.col("cites") / age).alias("paper_mean_citations_per_year"), F.col("is_survey").cast("int").alias("is_survey"),
        F.col("cites_0").alias("paper_citations_delta_0"), F.col("cites_1").alias("paper_citations_delta_1"),
        F.col("keys_0").alias("paper_key_citations_delta_0"), F.col("keys_1").alias("paper_key_citations_delta_1"))


def paper_author_features(links: DataFrame, authors: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Summaries over a paper's authors, and their number."""
    rows = links.select("pid", "sid").join(authors, "sid")
    counts = F.count(F.lit(1)).alias("total_num_authors")
    aggs = [f(c).alias(f"{name}_{s}") for name, c in columns.items()
            for s, f in zip(STATS, (F.avg, F.min, F.max))]
    return rows.groupBy("pid").agg(counts, *aggs)


def paper_venue_features(venue_of: DataFrame, venues: DataFrame) -> DataFrame:
    named = venues.select("venue", *[F.col(c).alias(a) for a, c in PAPER_VENUE_COLUMNS.items()])
    return venue_of.select("pid", "venue").join(named, "venue").drop("venue")


def paper_table(links: DataFrame, papers: DataFrame, venue_of: DataFrame, axis: TimeAxis,
                iterations: int = 20) -> DataFrame:
    """The 63 paper features, keyed by ``pid``. Links and papers are read many times, so both are written first."""
    links, papers = materialise(links, "links"), materialise(papers, "papers")
    measures = ranked(author_measures(links, papers, axis), "mean_citations", "rank")
    authors = materialise(measures.join(author_network_features(links, axis, iterations), "sid"), "authors")
    columns = {**PAPER_AUTHOR_COLUMNS, **PAPER_NETWORK_COLUMNS, "author_mean_citation_rank": "rank"}
    return (paper_own_features(papers, venue_of, axis)
            .join(paper_author_features(links, authors, columns), "pid")
            .join(paper_venue_features(venue_of, venue_measures(venue_of, papers, axis)), "pid"))
